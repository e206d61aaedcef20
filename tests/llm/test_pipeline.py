"""The pipeline's rows on a small table against plain versions of its stages."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.common.table(spark, SF, "documents").cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    for i, t in rows.items():
        n, _, _, _, repeats = brute.quality(t)
        assert i not in kept or (n >= 20 and 100 * repeats <= 30 * n)
    unique = stages["near_duplicates"](spark, good, SF).cache()
    want = brute.near_duplicates([(i, rows[i]) for i in kept])
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in want.items() if c == i}
    clean = stages["secrets"](spark, unique, SF).cache()
    assert clean.columns == docs.columns and clean.count() == unique.count()
    for r in clean.collect():
        counts, _ = brute.secrets(r.text)
        assert sum(counts) == 0
    mixed = stages["mixture"](spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    tokens = stages["tokens"](spark, mixed, SF)
    assert tokens.count() == mixed.count()


def awkward_docs(spark):
    import random

    def text(seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(60))

    rows = [(i, text(i), ("en", None)[i % 2], ("a", "b", None)[i % 3]) for i in range(40)]
    rows += [(100, text(1), "en", "a"), (101, text(2) + " more", "en", "b"), (3, text(3), None, "a"), (3, text(60), "en", "a"), (None, text(61), "en", None), (None, text(61), "en", None)]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "few words", "en", "a"), (203, " ".join(text(k) for k in range(1000, 1600)), "en", "b"), (204, text(70) + " password = Zx81kQ0pLm7sT2v9", "en", "b")]
    schema = "doc_id long, text string, lang string, source string, _row string, spans string, size string, n_words string, kept string"
    return spark.createDataFrame([(*x, "r", "s", "z", "w", "k") for x in rows], schema)


def test_awkward_rows_pass_every_stage(spark):
    docs = awkward_docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    texts = [(r.doc_id, r.text) for r in good.collect()]
    want = [(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if t and len(t.split()) >= 20]
    assert sorted(texts, key=str) == sorted(want, key=str) and good.columns == docs.columns
    unique = stages["near_duplicates"](spark, docs, SF)
    left = [(r.doc_id, r.text) for r in unique.collect()]
    assert [i for i, _ in left].count(None) == 2 and [t for i, t in left if i == 3] != [] and len([1 for i, _ in left if i == 3]) == 2
    assert not {100, 101} & {i for i, _ in left} and {200, 201, 202, 203, 204} <= {i for i, _ in left}
    assert sorted(left, key=str) == sorted(((r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs.orderBy("text"), SF).collect()), key=str)
    clean = stages["secrets"](spark, docs, SF)
    assert clean.count() == docs.count() and all((r._row, r.spans, r.size, r.n_words, r.kept) == ("r", "s", "z", "w", "k") for r in clean.collect())
    assert [r.text for r in clean.where("doc_id = 204").collect()][0].endswith("[secret]")
    mixed = stages["mixture"](spark, docs, SF)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}
    assert stages["tokens"](spark, docs, SF).count() == docs.count()
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_queries_of_the_operators(spark):
    """Each registered query itself on the smallest tables: one row for each document (or query), stable columns."""
    from pricelens.llm import queries

    docs = corpus_pipeline.common.table(spark, SF, "documents").count()
    for name, f in queries.QUERIES.items():
        out = f(spark, SF).toPandas()
        assert len(out) == docs if name != "op2_top_k" else len(out) % 5 == 0, name
    rows = {r.doc_id: r.text for r in corpus_pipeline.common.table(spark, SF, "documents").collect()}
    found = queries.QUERIES["op1_substring_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == brute.substring_dedup(list(rows.items()))
    want = brute.near_duplicates(list(rows.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op4_near_dedup"](spark, SF).collect()} == want
    for r in queries.QUERIES["op7_secret_scan"](spark, SF).collect():
        counts, base = brute.secrets(rows[r.doc_id])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, brute.sha(base))
