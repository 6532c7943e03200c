"""The elements of HTML pages as rows, and what is read from them: titles, links, structured data and postings.

One tokenizer reads each page once. Everything else is a filter, a group or a
join over its rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, jobs, text
from ..operators.ranked import checkpointed, once

#: Elements whose text is kept with their row.
TEXTS = ("title", "h1", "a", "script")
#: Fixed values of HTML: elements without content, those that start a line, and those that don't show.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr section article".split())
HIDDEN = frozenset("script style noscript svg template".split())
#: Elements that end when one of their own kind starts right within them.
CLOSED_BY = {"li": {"li"}, "a": {"a"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, **{f"h{k}": {f"h{j}" for j in range(1, 7)} for k in range(1, 7)}}
#: Elements of a path at most, the innermost ones.
PATH = 12
DOCUMENT = "#document"
SLICE = 32

#: Elements that postings are read from.
POSTING_TAGS = ("script", "meta", "title", "h1", DOCUMENT)

#: Paths of postings, of roles, and of other pages; labels that lead to the next page.
JOB_PATH = r"(?i)/(?:jobs?|careers?|positions?|openings?|vacanc(?:y|ies)|requisitions?|opportunit(?:y|ies)|o|roles?|postings?|job-details|jobdetails)(?:/|$|\?)"
ROLE_SLUG = r"(?i)data[-_ ]?(?:engineer|platform|infra)|big[-_ ]?data|distributed[-_ ]?systems|platform[-_ ]?engineer|infrastructure[-_ ]?engineer|\betl\b"
NOT_JOB = r"(?i)/(?:login|signin|sign-in|privacy|terms|cookie|blog|news|press|about|contact|faq|benefits|culture|events|students|alerts|talent-community)(?:/|$)"
NEXT_LABEL = r"(?i)^\s*(?:next|next page|more jobs|load more|›|»)\s*$"


#: Plain tags, as nearly all are; others are left to the parser.
START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9_:.-]*+(?:="[^"]*+"|='[^']*+')?+)*+)[ \t\n\r\f]*+(/?)>""")
GIVEN = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:.-]*+)(?:="([^"]*+)"|='([^']*+)')?+""")
END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*+)[ \t\n\r\f]*+>")


class Reader(HTMLParser):
    """Rows (n, tag, path, attributes, text) of a page, in the order in which elements start; the last is the whole page. With `tags` only theirs."""

    def __init__(self, tags: Collection[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = tags
        self.whole_page = tags is None or DOCUMENT in tags
        self.rows: list[list] = []
        self.n = 0
        self.open: list[tuple[str, int]] = []
        self.tags: Counter = Counter()
        self.hidden = 0  # open elements that don't show
        self.seen: list[str] = []  # what shows of the page
        self.kept: dict[int, tuple[list, list[str]]] = {}  # rows of open elements that keep their texts, and the texts

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines aren't counted

    def parse_starttag(self, i: int) -> int:
        plain = START.match(self.rawdata, i)
        tag = plain and plain[1].lower()
        if not plain or tag in self.CDATA_CONTENT_ELEMENTS:
            return super().parse_starttag(i)
        attrs = [(k.lower(), unescape(v or w)) for k, v, w in GIVEN.findall(plain[2])] if plain[2] else []
        (self.handle_startendtag if plain[3] else self.handle_starttag)(tag, attrs)
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def _pop(self) -> None:
        tag, n = self.open.pop()
        self.tags[tag] -= 1
        self.hidden -= tag in HIDDEN
        if n in self.kept:
            row, parts = self.kept.pop(n)
            row[4] = "".join(parts)

    def _say(self, what: str) -> None:
        if self.whole_page:
            self.seen.append(what)
        for _, parts in self.kept.values():
            parts.append(what)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED_BY:
            while self.open and self.open[-1][0] in CLOSED_BY[tag]:
                self._pop()
        if not self.hidden:
            self._say("\n" if tag in BLOCKS else " ")
        row = None
        if self.wanted is None or tag in self.wanted:
            path = "/".join([*(t for t, _ in self.open[-PATH + 1 :]), tag])
            row = [self.n, tag, path, [(k, v or "") for k, v in dict(reversed(attrs)).items()], None]
            self.rows.append(row)
        if tag not in VOID:
            self.open.append((tag, self.n))
            self.tags[tag] += 1
            self.hidden += tag in HIDDEN
            if row and tag in TEXTS:
                self.kept[self.n] = (row, [])
        self.n += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag] > 0:
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()
        if not self.hidden:
            self._say("\n" if tag in BLOCKS else " ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._say(data)
        elif self.open[-1][1] in self.kept:
            self.kept[self.open[-1][1]][1].append(data)

    def read(self, html: str | None, whole: bool = False) -> list[list]:
        html, mark = html or "", None
        if whole and any(not text.is_whole(name) for name in text.ENTITY.findall(html)):
            # The parser would decode these, so a character of private use that the page doesn't hold stands for their ampersands meanwhile.
            mark = next(c for c in map(chr, range(0xF0000, 0x10FFFF)) if c not in html)
            html = text.ENTITY.sub(lambda m: m[0] if text.is_whole(m[1]) else mark + m[1], html)
        self.feed(html)
        self.close()
        while self.open:
            self._pop()
        rows = [*self.rows, *([[self.n, DOCUMENT, "", [], "".join(self.seen)]] if self.whole_page else [])]
        if mark:
            plain = lambda value: value and value.replace(mark, "&")
            rows = [[n, plain(tag), plain(path), [(plain(k), plain(v)) for k, v in given], plain(shown)] for n, tag, path, given, shown in rows]
        return rows


_ROWS = pa.schema([("n", pa.int32()), ("tag", pa.string()), ("path", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def elements(pages: DataFrame, id_col: str, html_col: str, tags: Collection[str] | None = None, whole: bool = False) -> DataFrame:
    """id, n, tag, path, attributes, text: a row for each element that starts, and one "#document" for each page.

    path names the open elements, at most `PATH`. text is what shows of titles,
    first headings and links, the code of scripts, and of "#document" what shows
    of the whole page; null for other elements. Entities are decoded, of
    attributes given twice the first counts, ends that nothing opened are passed over, and what is
    left open ends with the page. Null pages have "#document" alone. With `tags` only elements of these become rows.
    With `whole` entities that were cut short of their semicolon stay as they are, but for amp.
    """
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [Reader(tags).read(h, whole) for h in part.column("html").to_pylist()]
                where = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
                flat = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * len(_ROWS)
                yield pa.RecordBatch.from_arrays([part.column("id").take(where), *(pa.array(c, t) for c, t in zip(flat, _ROWS.types, strict=True))], names=["id", *_ROWS.names])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, n int, tag string, path string, attributes map<string, string>, text string").withColumn("text", tidy(F.col("text")))


def tidy(value: Column) -> Column:
    """Runs of spaces as one, lines without spaces at their ends, no empty lines. Code keeps its lines too."""
    value = F.regexp_replace(F.regexp_replace(value, r"[ \t\r\f\x0B]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def titles(found: DataFrame, heading_letters: int | None = 300) -> DataFrame:
    """id, title, heading of each page: og:title before the title, and the first main heading, its first letters or all of it; null where there is none."""
    tag, given = F.col("tag"), F.lower(F.coalesce(F.element_at("attributes", "property"), F.lit("")))
    line = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    og = F.when((tag == "meta") & (given == "og:title"), line(F.element_at("attributes", "content")))
    own, head = F.when((tag == "title") & ~F.col("path").contains("svg"), line(F.col("text"))), F.when(tag == "h1", F.nullif(F.substring("text", 1, heading_letters) if heading_letters else F.col("text"), F.lit("")))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col("n"), c.alias("v"))))["v"]
    return found.groupBy("id").agg(F.coalesce(first(og), first(own)).alias("title"), first(head).alias("heading"))


def links(found: DataFrame, urls: DataFrame, label_letters: int = 300) -> DataFrame:
    """id, link, label, place: absolute links of pages, each once a page with its first label, counted from 0.

    `urls` has id and url, one for each page. Links without an address, to a
    place on the page, or to what isn't the web are left out.
    """
    rows = found.where((F.col("tag") == "a") & F.element_at("attributes", "href").rlike("^[^#]"))
    rows = rows.select("id", "n", F.trim(F.element_at("attributes", "href")).alias("_href"), F.substring("text", 1, label_letters).alias("label"))
    rows = rows.withColumn("place", F.row_number().over(_by_place()) - 1).join(urls.select("id", F.col("url").alias("_base")), "id")
    href = F.col("_href")
    root = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    absolute = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    rows = once(rows, ["id", "place", "label"], _absolute=absolute).where(F.col("_absolute").rlike("(?i)^https?://[^/?#]"))
    rows = rows.select("id", "place", text.canonical_url(F.col("_absolute")).alias("link"), "label")
    return rows.groupBy("id", "link").agg(F.min(F.struct("place", "label")).alias("f")).select("id", "link", "f.label", "f.place")


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("n")


def link_scores(found: DataFrame, urls: DataFrame) -> DataFrame:
    """links() with next (it leads to the next page of a list) and priority: 2 for a target role in the label, 1 for one in the address, 0 for other postings, null for what is none.

    A posting is on the page's own registrable domain or on an applicant system,
    and its address speaks of jobs or a role and of nothing else.
    """
    own = once(urls, ["id", "url"], _own=text.canonical_url(F.col("url")), _host=text.host_name(F.col("url")))
    rows = links(found, urls).join(own.select("id", "_own", text.registrable_domain(F.col("_host")).alias("_domain")), "id")
    rows = once(rows, rows.columns, _link_host=text.host_name(F.col("link")))
    rows = once(rows, rows.columns, _link_domain=text.registrable_domain(F.col("_link_host")))
    link, null = F.col("link"), F.lit(None).cast("string")
    path = F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    whole = F.concat(path, F.lit("?"), F.regexp_extract(link, r"\?([^#]*)", 1))
    near = F.coalesce(F.col("_link_domain") == F.col("_domain"), F.lit(False)) | jobs.platform_of(link)["platform"].isNotNull()
    slug = whole.rlike(ROLE_SLUG)
    posting = (link != F.col("_own")) & near & ~whole.rlike(NOT_JOB) & (whole.rlike(JOB_PATH) | slug)
    target = (F.col("label") != "") & jobs.names_target(F.col("label"), null, null)
    rows = rows.withColumn("next", F.coalesce(F.col("label").rlike(NEXT_LABEL), F.lit(False)))
    return rows.select("id", "link", "label", "place", "next", F.when(posting & ~F.col("next"), F.when(target, 2).when(slug, 1).otherwise(0)).alias("priority"))


def structured(found: DataFrame) -> DataFrame:
    """id, n, object: JSON objects of pages' JSON-LD scripts, at the top, in lists and in @graph; what can't be read is left out."""
    rows = found.where((F.col("tag") == "script") & F.lower(F.trim(F.element_at("attributes", "type"))).isin("application/ld+json"))
    rows = rows.select("id", "n", F.trim(F.regexp_replace("text", r",\s*([}\]])", "$1")).alias("json"))
    as_list = F.when(F.col("json").startswith("["), F.from_json("json", "array<string>")).otherwise(F.array("json"))
    rows = rows.select("id", "n", F.explode(as_list).alias("o"))
    graph = F.from_json(F.get_json_object("o", "$['@graph']"), "array<string>")
    return rows.select("id", "n", F.explode(F.concat(F.array("o"), F.coalesce(graph, F.array().cast("array<string>")))).alias("object")).where("object is not null")


def structured_postings(found: DataFrame) -> DataFrame:
    """JobPosting objects of structured(): id, title, company, location, posted_at, posted_at_precision, description, identifier, employment_type."""
    get = lambda path: F.get_json_object("object", path)
    rows = structured(found).where(get("$['@type']").contains("JobPosting"))
    posted = dates.parse_posted(get("$.datePosted"))
    return rows.select(
        "id", F.nullif(F.trim(get("$.title")), F.lit("")).alias("title"), get("$.hiringOrganization.name").alias("company"), F.coalesce(get("$.jobLocation.address.addressLocality"), get("$.jobLocation[0].address.addressLocality")).alias("location"), posted["value"].alias("posted_at"), posted["precision"].alias("posted_at_precision"),
        text.html_to_text(get("$.description")).alias("description"), F.coalesce(get("$.identifier.value"), get("$.identifier")).alias("identifier"), get("$.employmentType").alias("employment_type"),
    )


def page_postings(found: DataFrame, urls: DataFrame, company: Column | None = None) -> DataFrame:
    """Postings of pages: id, title, location, description, structured, from structured data where a page has any, else from its heading.

    A page without structured postings is one itself if its first heading, or
    else its title, names a target role, judged with its whole text. Titles and texts are given as a whole. Structured postings without a title, and those of other roles,
    are left out; a page that has only such gives nothing.
    """
    null = F.lit(None).cast("string")
    target = lambda title, body: jobs.names_target(title, body, null if company is None else company)
    found = checkpointed(found.where(F.col("tag").isin(*POSTING_TAGS)))  # each page is read once
    given = structured_postings(found)
    whole = found.where(F.col("tag") == DOCUMENT).select("id", F.col("text").alias("description"))
    own = titles(found, None).join(whole, "id").join(given.select("id").distinct(), "id", "left_anti").select("id", F.coalesce("heading", "title").alias("title"), null.alias("location"), "description", F.lit(False).alias("structured"))
    both = given.select("id", "title", "location", "description", F.lit(True).alias("structured")).unionByName(own)
    return both.where(F.col("title").isNotNull() & target(F.col("title"), F.col("description"))).join(urls.select("id", "url"), "id", "left").withColumn("remote_status", jobs.remote_status(F.coalesce("location", F.when(~F.col("structured"), F.col("title")))))
