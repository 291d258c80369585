"""Quality (11), resampling (12) and collocations (13)."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from strandline.llm import collocations, quality, queries, resampling


def _duck(sql, sf_dir, **tables):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


@pytest.mark.parametrize("name", ["op12_word_tries", "op13_vertical_lists"])
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    got = [r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()]
    want = _duck(queries.oracle_sql()[name], sf_dir)
    order = lambda rows: sorted(tuple(sorted(r.items())) for r in rows)
    assert len(got) > 0 and order([{k: str(v) for k, v in r.items()} for r in got]) == order([{k: str(v) for k, v in r.items()} for r in want])


# --- resampling ---


def _runs(text, most):
    words = resampling.words((text or "").encode())
    return words, [b" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, most + 1) if i + k <= len(words)]


def _slow_resample(docs, target, most, buckets, percent, least):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in _runs(t, most)[1])
    s, t = count([d[1] for d in docs]), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for k, text in docs:
        words, found = _runs(text, most)
        h = int(sha256(f"2024:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found)
        rows.append([k, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    best = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for i, r in enumerate(best[: percent * len(best) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("most", "nodes"), [(1, 400_000), (3, 50)])
def test_resampling_against_plain_counts(spark, docs, corpus, monkeypatch, most, nodes):
    """Runs of several words, small tries that are emptied all the time, odd rows."""
    monkeypatch.setattr(resampling, "NODES", nodes)
    both = docs.select("doc_id", "text").unionByName(corpus.where("doc_id < 60").select("doc_id", "text"))
    target = corpus.where("doc_id between 60 and 90").select("text")
    got = resampling.resample(both, target, most=most, buckets=500, percent=30, least_words=3)
    rows = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)
    assert rows == _slow_resample([tuple(r) for r in both.collect()], [r[0] for r in target.collect()], most, 500, 30, 3)


def test_resampling_of_nothing(no_docs, docs):
    assert resampling.resample(no_docs, docs).count() == 0
    assert resampling.resample(docs, no_docs).count() == docs.count()


def test_rows_that_repeat_share_ranks_out(spark):
    same = spark.createDataFrame([(None, "a b c d e f")] * 40 + [(7, "a b")], "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resampling.resample(same, same, percent=50, least_words=3).collect() if r["rank"])
    assert ranks == list(range(1, 21))


# --- collocations ---


def _slow_phrases(docs, longest, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in "".join(c.lower() if "A" <= c <= "Z" else "\n" if c in ".,;:!?\n\r\x0b\x0c" else c for c in text or "").split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        f = {p: a for p, a in c.items() if a >= least}
        found = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 21, 37])
def test_collocations_against_plain_counts(spark, block):
    """Blocks that end inside texts and pieces, overlaps, ties, a language that is null, words beyond ASCII."""
    draw = np.random.default_rng(3)
    words = ["a", "A", "b", "c.", "d", "é,", "É", "\tf", "g\n", "a", "b"]
    texts = [(["x", "y", None][i % 3], " ".join(draw.choice(words, int(draw.integers(0, 60)))), i) for i in range(60)] + [("x", None, 1), (None, "", 2), ("x", "a a a a a a a a", 3), ("x", "a a a a a a a a", 3)]
    docs = spark.createDataFrame(texts, "lang string, text string, k int")
    got = collocations.collocations(docs, longest=4, least=4, top=9, block=block)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == _slow_phrases([t[:2] for t in texts], 4, 4, 9)


def test_collocations_of_odd_tables(docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    found = collocations.collocations(docs, least=2).collect()
    assert all(r["a"] >= 2 for r in found) and any(r["phrase"] == "lazy dog near the" for r in found)


def test_merge_join_of_lists():
    ids, last = np.array([5, 9]), np.array([5, 9])
    keys, lens, pos = collocations.extend(ids, last, np.array([3, 2]), np.array([0, 2, 5, 1, 6]), 100)
    assert keys.tolist() == [509, 905] and lens.tolist() == [2, 1] and pos.tolist() == [0, 5, 1]


# --- quality ---


def test_quality_is_learnt_and_held_out_rows_are_told_apart(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = quality.quality(docs, labels)
    told = rows.where("held_out").join(labels, "doc_id").collect()
    good = [r for r in told if r["quality"] == 1]
    assert rows.count() == docs.count() and rows.where("score between 0 and 1").count() == docs.count()
    assert sum(r["predicted"] == r["quality"] for r in told) >= 0.9 * len(told) and sum(r["predicted"] for r in good) >= 0.97 * len(good)
    for r in told:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_a_few_bad_passages_decide(spark):
    """Only the bag has a label; the passage that gives it away is one of many, at any place."""
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefgh"), int(draw.integers(2, 8))))
    plain = lambda: " ".join(word() for _ in range(64))
    odd = lambda: " ".join(word().upper() + "!!" for _ in range(64))
    texts, labels = [], []
    for i in range(240):
        parts = [plain() for _ in range(int(draw.integers(3, 9)))]
        if i % 2:
            parts[int(draw.integers(len(parts)))] = odd()
        texts.append(" ".join(parts).encode())
        labels.append(1 - i % 2)
    model = quality.train([quality.passages([t])[0] for t in texts[:160]], labels[:160])
    got = model.scores(texts[160:]) >= 0.5
    assert (got == np.array(labels[160:], bool)).mean() >= 0.95
    rows, of = quality.passages([texts[161]])
    _, attention = model.encode(rows)
    assert attention.argmax() == rows[:, quality._PAIRS + 7].argmax()  # the passage of capitals


def test_passages_depend_on_their_text_alone():
    texts = [b"One two. Three", b"  \n", b"", "é ñ 漢字 !!".encode(), b"\n lead and tail \n", b"w " * 500]
    together, of = quality.passages(texts)
    for i, t in enumerate(texts):
        alone, _ = quality.passages([t])
        assert np.allclose(together[of == i], alone) and len(alone) == -(-len(t.split()) // quality.PASSAGE)


def test_long_texts_are_scored_in_parts(monkeypatch):
    model = quality.train([quality.passages([t])[0] for t in (b"good words here " * 9, b"BAD!! WORDS!! " * 9) * 8], [1, 0] * 8)
    text = b"some words and more of them in a row " * 3000
    whole = model.scores([text, b"", b"x"])
    monkeypatch.setattr(quality, "PART", 64 * 37 * 8)
    assert np.allclose(model.scores([text, b"", b"x"]), whole, atol=1e-3)


def test_quality_of_odd_tables(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert quality.quality(no_docs, labels).count() == 0
    alone = {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()}
    assert alone == {0.5}
