"""Infobox rows as facts and lines, against hand-made pages."""

from pyspark.sql import functions as F

from fusemill.functions import articles

PAGE = """<h1>x</h1><table class="infobox vcard"><caption><div class="fn">Ada &amp; Co</div></caption>
<tr><th class="infobox-label">Born</th><td class="infobox-data"><span>1815</span><b><span>inner</span></b><div class="birthplace"><a>London</a>, <a></a><a>England</a></div></td></tr>
<tr><th>Header</th><td><a>skipped</a></td></tr><tr><td class="infobox-data"><a>no label</a></td></tr><tr><th class="infobox-label">No cell</th></tr>
<tr><th class="infobox-label">Fields</th><td class="infobox-data"><ul><li>Maths</li><li><a>Logic</a> 1</li><li></li></ul></td></tr></table>"""


def test_facts_of_a_page():
    assert articles.facts_of(PAGE, "Page") == [("Ada & Co", "Born", "1815"), ("Ada & Co", "Born", "London, England"), ("Ada & Co", "Fields", "Logic"), ("Ada & Co", "Fields", "Maths"), ("Ada & Co", "Fields", "Logic 1")]


def test_subject_and_pages_without_facts():
    row = '<tr><th class="infobox-label">L</th><td class="infobox-data"><a>v</a></td></tr>'
    assert articles.facts_of(f'<table class="infobox">{row}</table>', "Page") == [("Page", "L", "v")]
    assert articles.facts_of(f'<table class="infobox">{row}</table>') == [("", "L", "v")]
    for html in (None, "", "<p>x</p>", f"<table class='infobox-like'>{row}</table>", "<table class='infobox'></table>", "<table class=infobox><tr><th class=infobox-label>x"):
        assert articles.facts_of(html, "Page") == []


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "P"), (2, None, None), (3, "x" * 100_000, "P")], "id int, html string, title string")
    out = df.select("id", articles.infobox_facts(F.col("html"), F.col("title")).alias("f")).withColumn("t", articles.infobox_text(F.col("f"))).collect()
    texts = {r.id: r.t for r in out}
    assert texts[1].split("\n")[1] == "Ada & Co -- Born --> London, England" and texts[2] == texts[3] == ""
    assert df.limit(0).select(articles.infobox_facts(F.col("html"), F.col("title"))).collect() == []
