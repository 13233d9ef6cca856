"""Table-valued functions on odd input."""

from lexiloom.functions.table_valued import register_tables


def test_hrefs_of_null_empty_and_repeated_pages(spark):
    register_tables(spark)
    rows = [(1, None), (2, ""), (3, '<a href="x"></a><a href=""></a>'), (3, '<a href="x"></a><a href=""></a>')]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = [tuple(r) for r in spark.sql("SELECT * FROM page_hrefs(TABLE(SELECT * FROM {p}))", p=pages).collect()]
    assert sorted(got) == sorted([(3, 1, "x"), (3, 2, "")] * 2)
    assert spark.sql("SELECT * FROM page_hrefs(TABLE(SELECT * FROM {p}))", p=pages.limit(0)).count() == 0


def test_batches_follow_the_order_and_start_anew_in_each_partition(spark):
    register_tables(spark)
    rows = [(i, "a" if i % 3 else None) for i in range(50)]
    docs = spark.createDataFrame(rows, "id long, lang string")
    cut = "SELECT * FROM cut_batches(TABLE(SELECT * FROM {d}) PARTITION BY lang ORDER BY (id DESC), 4)"
    got = {r.id: (r.batch, r.place) for r in spark.sql(cut, d=docs).collect()}
    want = {}
    for lang in ("a", None):
        for at, i in enumerate(sorted((i for i, l in rows if l == lang), reverse=True)):
            want[i] = (at // 4 + 1, at % 4 + 1)
    assert got == want
