"""Spelling variants, packing and clustering against plain versions."""

import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from test_operators import awkward, frame, words  # noqa: E402

from pricelens.llm import clustering, packing, spelling  # noqa: E402
from pricelens.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def variants_of(spark, rows):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, rows)).collect()))


def test_spelling_variants(spark):
    r = random.Random(5)
    names = ["banana", "banane", "bananas", "bnana", "aabbcc", "abbcc", "aaabbcc", "ÀÉîcole", "éîcole", "éîcol", "éîcola", "straße", "strasse", "a" * 3000, "a" * 2999 + "b", "a" * 3001]
    rows = [(i, " ".join(r.choice(names) for _ in range(r.randrange(40)))) for i in range(60)]
    rows += [(100 + i, "letter" * (i % 3) + " lettex lettey " + "lettez " * i) for i in range(9)]
    rows += [(200, "chain " * 64 + "chaim " * 31 + "chaib " * 30), (201, "chaiq " * 200), (202, "chaxn " * 7 + "chayn " * 3 + "czayn " * 3)]
    rows += [(None, "banana × ÷ banana2banana"), (None, None), (300, ""), (300, "banana" * 2), *awkward()]
    assert variants_of(spark, rows) == brute.spelling(rows)
    assert variants_of(spark, []) == []


def test_spelling_of_the_documents_is_that_of_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = spelling.op11_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute.spelling(docs)


def test_equal_keys_of_other_strings_are_told_apart(spark, monkeypatch):
    """With a hash that is the length alone every key collides; the strings decide."""
    monkeypatch.setattr(spelling, "meeting", lambda t: t.select(["pos", "id", "first"]))
    rows = [(0, "banana bananas banane bnana orange oranges strange " * 5)]
    assert variants_of(spark, rows) == brute.spelling(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    text = words(3, 200) + " " + "é" * 300 + "中" * 90 + " word" * 30
    raw = text.encode()
    assert b"".join(spelling.pieces(raw)) == raw and max(map(len, spelling.pieces(raw))) < 1000
    assert sum((spelling.RUN.findall(p) for p in spelling.pieces(raw)), []) == spelling.RUN.findall(raw)


def test_deletion_keys_are_those_of_the_strings():
    names = ["aabb", "abb", "é", "banana", "banan", ""]
    word, pos, key, first = spelling.deletion_keys(names)
    of = {}
    for w, p, k, f in zip(word, pos, key, first):
        s = names[w] if p < 0 else names[w][:p] + names[w][p + 1 :]
        assert of.setdefault(s, k) == k
        assert f == (p >= 0 and (p == 0 or names[w][p] != names[w][p - 1]))
    assert len(set(of.values())) == len(of)


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= size
    return len(by)


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    rows = [*awkward(), (500, words(9, 9000)), (501, "a" * 2047), (502, " the" * 2047), (503, " the" * 2048), (504, " the" * 4095)]
    parts = packing.pieces(frame(spark, rows))
    got = packing.packed(parts).collect()
    sequences = check_packing(got, 2048)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        borders = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, z - a, np.array(ids[a:z], "<u4").tobytes()) for k, (a, z) in enumerate(zip(borders, borders[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    assert sequences <= -(-sum(r.length for r in got) // 2048) + 2
    whole = packing.assembled(packing.packed(parts)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in got) and max(len(r.ids) for r in whole) <= 4 * 2048
    assert packing.packed(packing.pieces(frame(spark, []))).count() == 0


def test_packing_query(spark):
    got = packing.op12_best_fit_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    check_packing(rows, 2048)
    parts = {(r.doc_id, r.piece): (r.length, zlib.crc32(bytes(r.ids))) for r in packing.pieces(table(spark, SF, "documents")).collect()}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in rows} == parts


def test_packing_in_shards_loses_little(spark):
    r = random.Random(2)
    sizes = [min(2047, int(r.lognormvariate(5.5, 1)) + 1) for _ in range(12_000)] + [2048] * 50
    got = packing.packed(spark.createDataFrame([(s,) for s in sizes], "length int"), shard=2000).collect()
    assert len(got) == len(sizes)
    assert check_packing(got, 2048) <= -(-sum(sizes) // 2048) * 1.004 + 1


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    r = random.Random(3)
    for size in (7, 20):
        lengths = [r.randrange(1, size + 1) for _ in range(300)]
        at, offset, gaps = packing.placed(lengths, size)
        fill = {}
        for s, k, o in zip(lengths, at, offset):
            count = np.bincount([size - x for x in fill.values()], minlength=size + 1)
            square = lambda c: int((c[1:size] ** 2).sum())
            options = []
            for g in [*range(s, size), size]:
                if g == size or count[g]:
                    c = count.copy()
                    if g < size:
                        c[g] -= 1
                    c[g - s] += 1
                    options.append((square(c), g))
            assert size - o == min(options)[1] and fill.get(k, 0) == o
            fill[k] = o + s
        assert [size - fill[k] for k in range(len(gaps))] == gaps


VECTORS = "vec_id long, embedding array<double>, cluster string"


def vectors(seed, n, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, 64))
    return [(i, (centres[i % 20] + spread * r.normal(size=64)).tolist()) for i in range(n)]


def clustered(spark, rows):
    out = clustering.clustered(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, brute.sha(r.centroid)) for r in out), key=str)


def test_clustering(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 400) + [(1000 + i, [float(i % 2)] * 64) for i in range(40)]  # ties
    rows += [(None, [0.5] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [None] + [1.0] * 63), (11, [nan] * 64), (12, [1.0] * 63 + [inf]), (3, [0.25] * 64)]
    assert clustered(spark, rows) == brute.clusters(rows)
    assert clustered(spark, rows[:5]) == brute.clusters(rows[:5])
    assert clustered(spark, []) == []


def test_clustering_of_huge_components_is_exact(spark):
    rows = vectors(2, 60) + [(100, [1e30] * 64), (101, [-(2.0**40)] * 64), (102, [1.7e308] * 64), (103, [2.0**40 + 1] * 64)]
    assert clustered(spark, rows) == brute.clusters(rows)


def test_bounds_never_exclude_the_nearest_and_spare_distances():
    r = np.random.default_rng(4)
    centres = (r.normal(size=(16, 64)) * 64 * r.uniform(0.1, 6, size=(16, 1))).astype(np.int64)
    x = (centres[r.integers(0, 16, 3000)] + r.normal(size=(3000, 64)) * 4).astype(np.int64)
    x[:16] = centres
    norms = np.sqrt(np.add.reduceat(x**2, range(0, 64, 8), 1).astype(float))
    measured = []
    place, best = clustering.nearest(x, norms, centres, measured)
    all_ = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (place == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert measured[0] < 0.5 * all_.size


def test_merge_rounds_equal_the_trie_walk():
    from pricelens.llm.bpe import Bpe, tokenizer_path
    from pricelens.llm.merge_rounds import RoundsBpe

    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    a, b = Bpe(definition), RoundsBpe(definition)
    r = random.Random(8)
    names = {"".join(r.choice("etaoin shrdlué中\t\n'09") for _ in range(r.randrange(1, 45))) for _ in range(4000)} | {"", "a" * 300, "ab" * 100, " the", "\U0001f600" * 9}
    assert b.encode_words(names) == a.encode_words(names)
    texts = [t or "" for _, t in awkward()]
    assert b.encode(texts) == a.encode(texts)


def test_frames_with_one_tokenizer_file_share_one_tokenizer(spark):
    from pricelens.llm import common
    from pricelens.llm.bpe import shared_bpe

    first, second = shared_bpe(spark), shared_bpe(spark)
    assert first() is second()
    assert sum(k.startswith("Bpe ") for k in common._HELD) == 1


def test_pre_tokens_cut_together_equal_the_library():
    from tokenizers import Tokenizer

    from pricelens.llm.bpe import Bpe, tokenizer_path
    from pricelens.llm.merge_rounds import RoundsBpe

    r = random.Random(5)
    letters = [*"aab the stmd ''  \n\n\t\r\x0b1 22 .,;#-é漢字ñ\u00a0\u2003\u3000\u0301\u200b\x85\x1c\x00٣²½ª😀", "'s", "'re", "'ll", " '", "ve", "<|endoftext|>"]
    texts = ["".join(r.choices(letters, k=r.choice([0, 1, 2, 3, 5, 9, 30, 80]))) for _ in range(3000)]
    texts += ["'", "''", "'s", "x'", " a", "a\x00", "\x00" * 30, "\n" * 100 + "x", " " * 300, "漢" * 20, "it'summer 'tis 're'll", "a" * 23, "a" * 24]
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    with open(tokenizer_path(), encoding="utf-8") as f:
        definition = f.read()
    for kind in (Bpe, RoundsBpe):
        mine = kind(definition)
        mine.known.limit = 500  # the table is emptied on the way
        assert [x for k in range(0, len(texts), 100) for x in mine.encode(texts[k : k + 100])] == want
        assert mine.known.entries < 500 + 100 * 80  # bounded by the limit and one slice
        assert mine.encode([]) == [] and mine.encode(["", ""]) == [b"", b""]
