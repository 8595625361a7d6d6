from tessera.operators import graph as G


def tables(spark):
    # page ids of categories and their titles
    page = spark.createDataFrame(
        [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E")], "page_id long, page_title string")
    links = spark.createDataFrame([
        (1, "ROOT", "subcat"),   # A under ROOT
        (2, "A", "subcat"),      # B under A
        (3, "A", "subcat"),      # C under A
        (4, "B", "subcat"),      # D under B   (diamond: D under B and C)
        (4, "C", "subcat"),
        (1, "D", "subcat"),      # cycle: A under D
        (9, "D", "subcat"),      # subcat with no title row -> dropped
        (100, "ROOT", "page"), (101, "A", "page"), (102, "B", "page"), (103, "D", "page"),
        (104, "E", "page"), (105, "SEED2", "page"),
    ], "cl_from long, cl_to string, cl_type string")
    return page, links


def pages(df):
    return sorted(r[0] for r in df.collect())


def test_depths(spark):
    page, links = tables(spark)
    assert pages(G.category_descent(links, page, ["ROOT"], 0)) == [100]
    assert pages(G.category_descent(links, page, ["ROOT"], 1)) == [100, 101]
    assert pages(G.category_descent(links, page, ["ROOT"], 2)) == [100, 101, 102]
    assert pages(G.category_descent(links, page, ["ROOT"], 3)) == [100, 101, 102, 103]


def test_cycle_terminates_and_diamond_counted_once(spark):
    page, links = tables(spark)
    cats = G.descent_categories(links, page, ["ROOT"], 10)
    got = sorted((r["category"], r["depth"]) for r in cats.collect())
    assert got == [("A", 1), ("B", 2), ("C", 2), ("D", 3), ("ROOT", 0)]


def test_two_seeds_union_and_missing(spark):
    page, links = tables(spark)
    assert pages(G.category_descent(links, page, ["E", "SEED2", "NOPE"], 2)) == [104, 105]


def test_members_and_titles(spark):
    page, links = tables(spark)
    fr = spark.createDataFrame([("A",)], "category string")
    got = sorted((r["member_id"], r["kind"], r["child_title"]) for r in G.category_members(fr, links, page).collect())
    assert got == [(2, "subcat", "B"), (3, "subcat", "C"), (101, "page", None)]
    edges = G.subcategory_edges(links, page)
    assert edges.filter("child IS NULL").count() == 0
    assert edges.count() == 6  # the subcat with no title row is dropped
