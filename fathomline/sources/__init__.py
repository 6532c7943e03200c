"""Landing tables: raw payloads of boards and feeds, read into one posting schema.

Fetching pages is left to whatever fills the landing folder; these readers take
its JSON and HTML from there.
"""
