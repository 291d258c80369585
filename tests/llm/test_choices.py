"""Licences (6), packing (7), toxicity (8), mixing (9) and the pipeline."""

import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import licenses, mixing, packing, toxicity
from strandline.llm.common import WORD


def test_licences(spark, docs, no_docs):
    mit = licenses.TEMPLATES["MIT-text"]
    texts = [(1, f"before it\n{mit.upper()}\nafter it"), (2, "Code is released under the MIT License. Done."), (3, "released under the wide license"), (4, mit[:200]), (5, None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["license"] == "MIT-text" and got[1]["dice"] == 1.0 and got[1]["first_word"] == 2
    assert (got[2]["license"], got[2]["first_word"], got[2]["n_words"]) == ("MIT", 2, 5)
    assert [got[i]["license"] for i in (3, 4, 5)] == [None] * 3 and got[5]["licenses"] == []
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(no_docs).count() == 0


def _slow_dice(words, template):
    """The best coefficient over all passages within the size bounds."""
    wanted = set(zip(template, template[1:]))
    best = 0.0
    for i in range(len(words)):
        for j in range(i + 2, min(len(words), i + 2 * len(template)) + 1):
            own = set(zip(words[i:j], words[i + 1 : j]))
            best = max(best, 2 * len(own & wanted) / (len(own) + len(wanted)))
    return best


def _changed(base, share, draw):
    """``base`` with some words put in place of others, left out or added."""
    words = list(base)
    for _ in range(int(len(base) * share)):
        at = int(draw.integers(len(words)))
        words[at : at + 1] = [["changed"], [], [words[at], "more"]][int(draw.integers(3))]
    return words


def test_pruning_loses_no_template():
    """Every template, changed by more and more, against all passages."""
    scanner, draw = licenses.Scanner(), np.random.default_rng(4)
    assert len(licenses.TEMPLATES) >= 30
    for name, text in licenses.TEMPLATES.items():
        base = licenses.normalise(text)
        for share in (0.0, 0.03, 0.06) if len(base) < 60 else (0.04,):
            words = ["intro"] * 3 + _changed(base, share, draw) + ["outro"] * 3
            found = {f[0]: f[1] for f in scanner.scan(" ".join(words))}
            best = _slow_dice(words, base) if len(base) < 60 else None
            if best is None:  # the whole changed text is a passage, so the best one is at least as near
                own = set(zip(words[3:-3], words[4:-3]))
                assert found.get(name, 0) >= 2 * len(own & set(zip(base, base[1:]))) / (len(own) + len(set(zip(base, base[1:])))) - 1e-12
            else:
                assert (name in found) == (best >= licenses.LEAST) and found.get(name, best) == pytest.approx(best)


def _words(text):
    return re.findall(WORD, text or "", re.ASCII)


def test_packing(spark, docs, no_docs):
    rows = packing.pack(docs).collect()
    sizes, bins, copies = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["doc_id"]] += r["size"]
        bins[r["bin_id"]].append((r["bin_offset"], r["size"], r["bin_length"]))
        copies[r["doc_id"]].add(r["copy"])
    want = defaultdict(int)
    for r in docs.collect():
        want[r["doc_id"]] += len(_words(r["text"])) + 1
    assert sizes == want and copies[6] == {0, 1} and packing.pack(no_docs).count() == 0 and packing.sequences(no_docs).count() == 0
    for pieces in bins.values():
        at = 0
        for offset, size, length in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length and length == min(n for n in packing.LENGTHS if n >= at)
    again = packing.pack(docs.repartition(3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_every_word_is_in_one_sequence(spark, docs, corpus):
    both = docs.unionByName(corpus.where("doc_id > 1000"), allowMissingColumns=True)
    found = defaultdict(list)
    for s in packing.sequences(both).collect():
        bodies = s["text"].split(packing.END)
        assert bodies.pop() == "" and s["used"] == sum(s["sizes"]) <= s["bin_length"] and s["bin_length"] == min(n for n in packing.LENGTHS if n >= s["used"])
        at = 0
        for k, copy, piece, size, offset, body in zip(s["doc_ids"], s["copies"], s["pieces"], s["sizes"], s["offsets"], bodies, strict=True):
            assert offset == at
            at += size
            found[k, copy].append((piece, _words(body)))
    got = sorted(((k is None, k or 0), sum((w for _, w in sorted(parts)), [])) for (k, _), parts in found.items())
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), _words(r["text"])) for r in both.collect())
    assert got == want


def test_bodies_give_pieces_back_whatever_they_hold(spark):
    texts = ["a \0 b", "\0", "\1a", "\1", "x\0\1\0y <|endoftext|> z", "", "plain"]
    rows = packing.sequences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(k, b) for s in rows for k, b in zip(s["doc_ids"], packing.bodies(s["text"]), strict=True)} == set(enumerate(texts))


def _slow_fit(sizes, opened):
    """Best fit over plain lists: every open bin is looked at for every piece."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in bins if b[0] - sum(b[1]) >= size]
        if fitting:
            min(fitting, key=lambda b: b[0] - sum(b[1]))[1].append(size)
        else:
            bins.append((min((n for n in opened if n >= size), key=lambda n: packing.cost(n) / n), [size]))
    return sum(packing.cost(min(n for n in packing.LENGTHS if n >= sum(held))) for _, held in bins)


def test_best_fit_takes_the_tightest_room():
    draw = np.random.default_rng(1)
    for high in (300, 1200, 4096):
        sizes = draw.integers(1, high + 1, 150)
        bins, offsets, final = packing.best_fit(sizes)
        ours = sum(packing.cost(n) for n in {b: int(f) for b, f in zip(bins, final, strict=True)}.values())
        needed = min(n for n in packing.LENGTHS if n >= sizes.max())
        sets = [s for k in range(1, 6) for s in combinations(packing.LENGTHS, k) if needed in s]
        assert ours == pytest.approx(min(_slow_fit(sizes.tolist(), s) for s in sets))
        for b in set(bins.tolist()):
            held = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist()))
            assert [o for o, _ in held] == [sum(s for _, s in held[:i]) for i in range(len(held))]
    assert len(packing.best_fit(np.array([], np.int64))[0]) == 0


def test_toxicity_learns_pairs():
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(4000):
        a, b = (draw.random(2) < 0.5).tolist()
        words = [f"w{i}" for i in draw.integers(0, 40, 8)] + ["insult"] * a + ["group"] * b
        rows.append(toxicity.terms(" ".join(words)))
        labels.append(int(a and b))
    machine = toxicity.train(rows, labels)
    both, one, other = (machine.score(f"w1 w2 {t}") for t in ("insult group", "insult", "group"))
    assert both > 0.5 > max(one, other)
    place = [machine.place[toxicity.terms(t)[0]] for t in ("insult", "group")]
    assert machine.vectors[place[0]] @ machine.vectors[place[1]] > 0


def test_toxicity_learns_words_that_are_neutral_alone():
    """Label 1 exactly if one of two words is there without the other, which no sum of weights can tell."""
    draw = np.random.default_rng(5)

    def text():
        a, b = (draw.random(2) < 0.5).tolist()
        return " ".join([f"w{i}" for i in draw.integers(0, 40, 8)] + ["insult"] * a + ["group"] * b), int(a != b)

    some = [text() for _ in range(4000)]
    machine = toxicity.train([toxicity.terms(t) for t, _ in some], [y for _, y in some])
    fresh = [text() for _ in range(400)]
    right = np.mean([(machine.score(t) >= 0.5) == y for t, y in fresh])
    linear = toxicity.Machine(machine.bias, machine.place, machine.weights, machine.vectors * 0)
    assert right > 0.95 and np.mean([(linear.score(t) >= 0.5) == y for t, y in fresh]) < 0.8


def test_toxicity_margin_is_the_sum_over_pairs():
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 60, 9)) for _ in range(600)]
    machine = toxicity.train([toxicity.terms(t) for t in texts], [int("w7" in t.split()) for t in texts])
    for t in texts[:30]:
        r = machine.rows(toxicity.terms(t)).tolist()
        slow = machine.bias + sum(machine.weights[i] for i in r) + sum(machine.vectors[i] @ machine.vectors[j] for x, i in enumerate(r) for j in r[:x])
        assert machine.score(t) == pytest.approx(1 / (1 + np.exp(-slow)))


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = toxicity.fit(docs, labels)
    some = docs.join(labels, "doc_id").where(toxicity.held_out())
    rows = toxicity.score(some, machine).join(labels, "doc_id").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) > 500 and all(r["held_out"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean(right) > 0.95 and all(r["predicted"] == 0 or r["toxic"] == 1 for r in rows)


def test_toxicity_of_odd_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(no_docs, labels.limit(0)).count() == 0


def _slow_targets(sizes, share=1.5, weights=(5, 2, 1), limit=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out = dict(weight), {}
    total = share * sum(sizes.values())
    while left:
        room = total - sum(out.values())
        full = [s for s in left if room * left[s] / sum(left.values()) > limit * sizes[s]]
        if not full:
            return out | {s: room * left[s] / sum(left.values()) for s in left}
        for s in full:
            out[s] = limit * sizes[s]
            left.pop(s)
    return out


def test_mixing(spark, docs, no_docs, corpus):
    for df in (docs, corpus):
        rows = mixing.pareto_mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            most[r["source"]] = max(most[r["source"]], r["size"])
            assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        want = _slow_targets(sizes)
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    again = {(r["doc_id"], r["copies"]) for r in mixing.pareto_mix(corpus.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}
    assert mixing.pareto_mix(no_docs).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        if name in ("toxicity", "near-duplicates"):
            assert 0.7 * n < docs.count() <= n
        if name == "line dedup":
            assert docs.where("n_chars != length(text)").count() == 0
    assert corpus_pipeline.run(spark, sf).columns == ["bin_id", "bin_length", "used", "doc_ids", "copies", "pieces", "starts", "sizes", "offsets", "text"]


def test_stages_of_odd_tables(spark, docs, no_docs, tmp_path):
    """Nulls, empty, blank and very long texts, repeated rows, clashing columns, an empty table: every stage gives what its docstring states."""
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    have = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    by_name = dict(corpus_pipeline.STAGES)
    for name in list(by_name)[:-1]:
        out = by_name[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
        if name == "toxicity":
            assert got == have
        if name == "line dedup":
            assert len(got) == len(have) and {k for k, t in got if k == 6 and t} == set()
        if name == "near-duplicates":
            assert [k for k, _ in got] == [-1, 1, 2, 5, 8, 9]
        if name == "mixing":
            assert {k for k, _ in got} <= {k for k, _ in have} and not any(k in (2, 3, 4) for k, _ in got)
        assert by_name[name](spark, no_docs, str(tmp_path)).count() == 0, name
    assert by_name["packing"](spark, no_docs, str(tmp_path)).count() == 0
