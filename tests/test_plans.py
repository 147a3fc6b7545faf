"""Physical-plan checks: the scale properties the README claims."""

from opinia.plans.registry import load_all

from .conftest import SF_SMALL

QUERIES = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_one_exchange_broadcast_lexicon_and_pruned_scan(spark):
    p = _plan(QUERIES["g2_word_sentiment"].build(spark, SF_SMALL))
    assert p.count("Exchange hashpartitioning(_g") == 1 and p.count("Exchange hashpartitioning") == 2  # words; the lexicon
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert "ReadSchema: struct<text:string,lang:string>" in p


def test_partial_aggregation_before_exchange(spark):
    p = _plan(QUERIES["t5_word_frequency"].build(spark, SF_SMALL))
    assert "partial_count" in p


def test_knn_has_no_cartesian_product(spark):
    p = _plan(QUERIES["m1_knn_euclid_uniform"].build(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_naive_bayes_has_no_cartesian_product(spark):
    p = _plan(QUERIES["m4_naive_bayes"].build(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_plan_uses_cartesian_products(spark):
    skip = {"m2_decision_tree", "m3_random_forest_balanced", "m5_logistic_regression", "m6_stacking",
            "m7_kmeans_reviews", "m8_grid_search", "m10_rating_from_lexicon", "m11_predict", "f11_prepare",
            "m12_run_train", "st1_score_stream", "st2_word_sentiment_stream", "s1_read_reviews_csv",
            "s2_sniff_separator", "s6_write_nonnumeric_roundtrip"}
    for name, q in QUERIES.items():
        # fits, whose plans are MLlib's, and the checks that join a saved model's few nodes
        if name in skip or q.sql is None or "M2" in q.ops or "M3" in q.ops or "M6" in q.ops or "M8" in q.ops or "M10" in q.ops or "ST1" in q.ops:
            continue
        p = _plan(q.build(spark, SF_SMALL))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    for name in ("g6_sample_per_group", "m1_knn_euclid_uniform"):
        p = _plan(QUERIES[name].build(spark, SF_SMALL))
        assert p.count("WindowGroupLimit") >= 2, name  # partial (map side) + final


def test_tfidf_counts_only_vocabulary_terms(spark):
    p = _plan(QUERIES["f6a_tfidf_bigram_sublinear"].build(spark, SF_SMALL))
    # the (doc, term) aggregation sits above a broadcast probe of the vocabulary
    assert "BroadcastHashJoin" in p


def test_tfidf_fit_shuffles_by_term_only(spark):
    from opinia.operators import tfidf as TF

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = _plan(TF.term_stats(docs, "doc_id", "text", TF.SETTING_A))
    assert p.count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(term" in p and "hashpartitioning(id" not in p


def test_lexicon_rules_shuffle_no_token(spark):
    for name in ("l1_valence_scores", "l2_polarity"):
        p = _plan(QUERIES[name].build(spark, SF_SMALL))
        assert "Window" not in p and "Generate" in p, name
        # the per-text sums, and the look-up tables reduced to one row per word
        assert p.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(w" not in p.replace("hashpartitioning(word", ""), name


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_lexicon_explode_passes_no_text_and_no_array_up(spark):
    """Beside a copied text or array, per-text expressions would run once per token."""
    for name in ("l1_valence_scores", "l2_polarity"):
        plan = QUERIES[name].build(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
        generates = [n for n in _nodes(plan) if n.nodeName() == "Generate"]
        assert len(generates) == 1, name
        below = generates[0].children().apply(0).output().mkString(",")
        names = {x.split("#")[0] for x in below.split(",")}
        assert names == {"id", "_items", *(["_e", "_mixed", "_but"] if name.startswith("l1") else ["_blank"])}, below


def test_knn_gives_k_rows_per_query_and_block(spark):
    p = _plan(QUERIES["m1_knn_euclid_uniform"].build(spark, SF_SMALL))
    assert "MapInArrow" in p and "Join" not in p


def test_rating_keeps_no_scores_in_memory(spark):
    """Scores kept in memory would stand in for the scoring of every later query on the same texts."""
    QUERIES["m10_rating_from_lexicon"].build(spark, SF_SMALL)
    assert "InMemoryTableScan" not in _plan(QUERIES["l1_valence_scores"].build(spark, SF_SMALL))
