from tessera.operators import labels as L


def links_df(spark):
    return spark.createDataFrame(
        [(5, "b"), (5, "a"), (7, "c"), (7, "a"), (9, "b")], "doc_id long, label string")


def ids_df(spark):
    return spark.createDataFrame([(5,), (7,), (9,), (11,)], "doc_id long")


def test_labels_by_id_empty_list(spark):
    got = {r["doc_id"]: r["labels"] for r in L.labels_by_id(ids_df(spark), links_df(spark)).collect()}
    assert got == {5: ["a", "b"], 7: ["a", "c"], 9: ["b"], 11: []}


def test_dictionary_first_seen(spark):
    codes = {r["label"]: r["code"] for r in L.label_dictionary(links_df(spark)).collect()}
    # first seen by smallest doc id, then label
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_encode_keeps_order_and_empty(spark):
    lists = L.labels_by_id(ids_df(spark), links_df(spark))
    enc = {r["doc_id"]: r["codes"] for r in L.encode_labels(lists, L.label_dictionary(links_df(spark))).collect()}
    assert enc == {5: [0, 1], 7: [0, 2], 9: [1], 11: []}


def test_stats_pad_pairs(spark):
    lists = L.encode_labels(L.labels_by_id(ids_df(spark), links_df(spark)), L.label_dictionary(links_df(spark)))
    st = L.label_list_stats(lists).first()
    assert (st["n_samples"], st["max_len"], st["mean_len"]) == (5, 2, 1.25)
    padded = {r["doc_id"]: r["padded"] for r in L.pad_label_list(lists).collect()}
    assert padded == {5: [0, 1], 7: [0, 2], 9: [1, -1], 11: [-1, -1]}
    pairs = sorted((r["doc_id"], r["pos"], r["code"]) for r in L.explode_pairs(lists).collect())
    assert pairs == [(5, 0, 0), (5, 1, 1), (7, 0, 0), (7, 1, 2), (9, 0, 1)]
    assert L.count_labels(links_df(spark)).first()[0] == 3
