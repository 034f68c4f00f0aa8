from quarrysift.plans import catalog


def test_serp_normalize_reads_all_pages(spark, tmp_path):
    """The first hundred pages are of a spam host but ten; ids have gaps."""
    rows = []
    for i in range(0, 800, 2):
        host = "spam.example.com" if i < 200 and i % 20 else "good.example.com"
        rows.append((i, f"https://{host}/{i}", f"<title>t{i}</title><p>text {i}</p>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.ord, r.url, r.title) for r in catalog.serp_normalize(spark, str(tmp_path)).collect()]
    assert got == [(i, u, f"t{i}") for i, u, _ in rows if "spam" not in u][:60]


def test_html_extract_keeps_long_pages_whole(spark, tmp_path):
    words = "word " * 20_000
    spark.createDataFrame([(0, "u", f"<title>t</title><p>{words}end</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.html_extract(spark, str(tmp_path)).first().content == f"t {words}end"
