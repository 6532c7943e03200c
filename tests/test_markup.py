from __future__ import annotations

import html as entities
import re

from pyspark.sql import functions as F

from fathomline.plans import pages as plans
from fathomline.plans.registry import Tables
from fathomline.sources import markup


def found(spark, *pages):
    df = spark.createDataFrame([(i, p, "clash", 0) for i, p in enumerate(pages)], "page long, html string, id string, n int")
    return markup.elements(df, "page", "html")


def test_elements(spark):
    page = '<html><!-- <p> --><body CLASS=a class=b><ul><li>one<li>two<br/>x</ul></nothing><p>a<p>b &amp; c<script>var t="</p>";</script><a href="/x">L <i>i</i><a href=\'/y\'>M</a><svg><title>no</title></svg><h1>H</h1>'
    rows = [r for r in found(spark, page, None, "", "a < b && c").collect()]
    of = lambda k: sorted((r for r in rows if r.id == k), key=lambda r: r.n)
    assert [(r.tag, r.path) for r in of(0)] == [
        ("html", "html"), ("body", "html/body"), ("ul", "html/body/ul"), ("li", "html/body/ul/li"), ("li", "html/body/ul/li"), ("br", "html/body/ul/li/br"), ("p", "html/body/p"), ("p", "html/body/p"),
        ("script", "html/body/p/script"), ("a", "html/body/p/a"), ("i", "html/body/p/a/i"), ("a", "html/body/p/a"), ("svg", "html/body/p/svg"), ("title", "html/body/p/svg/title"), ("h1", "html/body/p/h1"), ("#document", ""),
    ]
    assert of(0)[1].attributes == {"class": "a"}
    assert [r.text for r in of(0) if r.text is not None] == ['var t="</p>";', "L i", "M", "no", "H", "one\ntwo\nx\na\nb & c L i M\nH"]
    assert [r.text for k in (1, 2, 3) for r in of(k)] == ["", "", "a < b && c"]


def test_hostile_pages_take_linear_work(spark):
    pages = ["<b>" * 30_000 + "x", "</b>" * 30_000, "<a>" * 30_000, "<h1>" * 20_000 + "t", "<" * 100_000, "<p " + "a=b " * 50_000 + ">", "<!--" * 20_000]
    rows = found(spark, *pages).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("path")).alias("path")).collect()
    assert len(rows) == len(pages) and max(r.path for r in rows) < 200


def test_titles(spark):
    pages = ['<title> a\n b </title><meta property="og:title" content="OG &amp; x"><h1>one <br> two</h1><h1>three</h1>', "<TITLE></TITLE><title>second</title>", "<svg><title>icon</title></svg><h1></h1><h1>later</h1>", "<meta property='og:title' content=''><title>t</title>", None]
    got = {r.id: (r.title, r.heading) for r in markup.titles(found(spark, *pages)).collect()}
    assert got == {0: ("OG & x", "one\ntwo"), 1: ("second", None), 2: (None, "later"), 3: ("t", None), 4: (None, None)}


def domain(url):
    host = re.sub(r"^https?://([^/?#]*).*", r"\1", url).lower()
    return ".".join(host.split(".")[-2:])


def plain_scores(url, page):
    """Every link of a page by one pattern, and its score by one condition after another."""
    out, place = {}, 0
    for href, label in re.findall(r'(?is)<a\b[^>]*?href="([^"#][^"]*)"[^>]*>(.*?)</a>', page):
        link = entities.unescape(href).strip()
        root = re.match(r"https?://[^/?#]*", url)[0]
        folder = re.match(r"https?://[^/?#]*(?:/[^?#]*/|/)?", url)[0]
        link = link if re.match("[a-z]+:", link) else root + link if link.startswith("/") else (folder if folder.endswith("/") else folder + "/") + link
        label = entities.unescape(re.sub("<[^>]+>", " ", label))
        label = re.sub(r"[ \t\r]+", " ", re.sub(r"\s*\n\s*", "\n", label)).strip()[:300]
        if link not in out:
            out[link] = (label, place)
        place += 1
    for link, (label, place) in out.items():
        path = re.sub(r"^https?://[^/?#]*", "", link)
        path = path if "?" in path else path + "?"
        following = bool(re.match(markup.NEXT_LABEL, label))
        near = domain(link) == domain(url) or "boards.greenhouse.io" in link
        slug = re.search(markup.ROLE_SLUG, path)
        score = None
        if near and not re.search(markup.NOT_JOB, path) and (re.search(markup.JOB_PATH, path) or slug) and not following:
            score = 2 if re.search(r"(?i)\b(data|platform) engineer\b", label) else 1 if slug else 0
        out[link] = (label, place, following, score)
    return out


def test_link_scores_of_all_pages(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    pages = {r.page_id: r for r in plans.listing_pages(t).collect()}
    got: dict = {k: {} for k in pages}
    for r in plans.page_link_scores(t).collect():
        got[r.page_id][r.link] = (r.label, r.place, r.next, r.priority)
    seen = set()
    for k, p in pages.items():
        want = plain_scores(p.url, p.html)
        assert got[k] == want, (k, [(x, got[k].get(x), want.get(x)) for x in {*got[k], *want} if got[k].get(x) != want.get(x)][:3])
        seen |= {x[3] for x in want.values()}
    assert seen == {None, 0, 1, 2}


def test_postings_of_all_pages(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = {}
    for r in plans.page_postings(t).collect():
        assert r.page_id not in rows
        rows[r.page_id] = r
    roles = ["Data Engineer", "Sales Manager", "Platform Engineer", "Data Analyst"]
    for p in plans.listing_pages(t).collect():
        k, wanted = p.page_id, roles[p.page_id % 4] in ("Data Engineer", "Platform Engineer")
        assert (k in rows) == (wanted and k % 5 < 4), k
        if k in rows:
            assert rows[k].structured == (k % 5 < 3) and rows[k].title.startswith(roles[k % 4])
            assert rows[k].description == "Spark" if k % 5 < 3 else rows[k].description.startswith(rows[k].title)
            assert rows[k].remote_status == ("remote" if k % 5 < 3 else "unknown")


def test_structured_data_that_cannot_be_read(spark):
    script = '<script type="application/ld+json">%s</script>'
    pages = [script % "{broken", script % "", script % "[1, 2]", script % '{"@type": "JobPosting"}', script % '{"@type": ["JobPosting"], "title": "Data Engineer", "jobLocation": [{"address": {"addressLocality": "Pune"}}]}', "<script>x</script>"]
    got = markup.structured_postings(found(spark, *pages)).collect()
    assert sorted((r.id, r.title, r.location) for r in got if r.title) == [(4, "Data Engineer", "Pune")]


def test_postings_are_judged_by_whole_texts(spark):
    far = "word " * 4000
    pages = [f"<h1>{'Software Engineer ' * 20}</h1><p>{far}</p>kafka airflow dbt flink", f"<h1>Software Engineer</h1><p>{far}", f"<h1>{'x ' * 200}Data Engineer</h1>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    rows = markup.page_postings(markup.elements(df, "id", "html"), df.select("id", F.lit("http://a.test/").alias("url"))).collect()
    got = {r.id: r for r in rows}
    assert sorted(got) == [0, 2]
    assert got[0].description.endswith("kafka airflow dbt flink") and got[0].title == ("Software Engineer " * 20).strip() and got[2].title.endswith("Data Engineer")
