"""Edit embedding (4), SimHash (5), line dedup (10) and components against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from strandline.llm import edit_embedding, line_dedup, simhash
from strandline.llm.components import banded_links, components


def test_neighbours_and_edits(docs, no_docs):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    want = []
    for i, r in enumerate(rows):
        t, other = texts[i], texts[i - 1]  # the next one in descending order; before the first comes the last
        cut = len(t) // 3
        edited = t[: len(t) - cut] + other[:cut]
        a, b, c = map(edit_embedding.fingerprint, (t, edited, other))
        want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    got = [tuple(r) for r in edit_embedding.embed_neighbours(docs).drop("own").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert edit_embedding.embed_neighbours(no_docs).count() == 0 and edit_embedding.embed_and_link(no_docs).count() == 0
    linked = edit_embedding.embed_and_link(docs).collect()
    assert len(linked) == docs.count() and {r["doc_id"]: r["component_id"] for r in linked} == {1: 1, 6: 1, 2: 2, 3: 2, 4: 4, 5: 5, 8: 8, 9: 9, None: None}


def test_likeness_follows_edits():
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefgh ") for _ in range(4000))
    other = "".join(draw.choice("abcdefgh ") for _ in range(4000))
    few = text[:1000] + "XYZ" + text[1001:3000] + text[3002:]
    a, b, c = map(edit_embedding.fingerprint, (text, few, other))
    assert edit_embedding.likeness(a, a) == 1 and edit_embedding.likeness(a, b) > 0.8 > 0.4 > edit_embedding.likeness(a, c)


def test_near_duplicates_of_edit_embedding(spark):
    draw = random.Random(6)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(900)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:850] + "!" + t[851:]) for i, t in enumerate(base)] + [(20, base[0]), (21, None), (22, "")]
    got = {r["doc_id"]: r["component_id"] for r in edit_embedding.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(5)}, **{10 + i: i for i in range(5)}, 20: 0, 21: 21, 22: 21}


def _slow_simhash(text):
    words = simhash._WORD.findall(text.encode().translate(simhash._LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_bit_by_bit(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r["text"] or "") == _slow_simhash(r["text"] or "")


def _classes(fps):
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_anchors_find_every_link(spark):
    draw = np.random.default_rng(2)
    fps = [int(x) for x in draw.integers(0, 2**63, 60)]
    for base in fps[:20]:
        for _ in range(6):
            base ^= int(sum(1 << int(b) for b in draw.choice(64, int(draw.integers(1, 4)), replace=False)))
            fps.append(base)
    fps = sorted(set(fps))
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    reached = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    keyed = {s[0]: f for s, f in zip(signed, fps, strict=True)}
    want = _classes(keyed)
    assert {k: reached.get(k, k) for k in keyed} == want and len(set(want.values())) < len(want)


def test_simhash_classes(docs, no_docs, corpus):
    for df in (docs, corpus):
        rows = df.where("doc_id is not null").collect()
        want = _classes({r["doc_id"]: _slow_simhash(r["text"] or "") for r in rows})
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).where("doc_id is not null").collect()}
        assert got == want
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k) == [1, 2, 5, 8, 9] and simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def _slow_drops(rows, least=0.8):
    first, at = {}, []
    for doc, text in sorted(rows):
        for p, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\f\v")
            if line:
                first.setdefault(line, (doc, p))
                at.append((doc, p, line))
    lines = list(first)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            k = len(sets[i] & sets[j]) if min(len(lines[i]), len(lines[j])) >= line_dedup.MIN_CHARS else 0
            if k and k >= least * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    stays = {}
    for i, x in enumerate(lines):
        stays[find(i)] = min(stays.get(find(i), first[x]), first[x])
    place = {x: stays[find(i)] for i, x in enumerate(lines)}
    return {(d, p) for d, p, x in at if (d, p) != place[x]}


def test_lines_against_all_pairs(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.orderBy("doc_id").limit(120).collect()]
    base = "the long line number %d has some words that do not repeat in any other line here, mark %d"
    rows += [(1000 + i, base % (i, i * i)) for i in range(3)] + [(2000, None), (2001, ""), (2002, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _slow_drops(rows)
    exact = _slow_drops(rows, least=1.0)
    got = {(r["id"], p) for r in line_dedup.doubles(df).collect() for p in r["drop"]}
    assert got <= want and exact <= got
    assert len(got - exact) >= 0.95 * len(want - exact) > 0
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert kept[2000]["text"] is None and kept[2001]["text"] == "" and kept[2002]["text"] == "short"
    for d, t in rows:
        if t is not None:
            assert kept[d]["text"] == "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in got)


def test_lines_of_odd_tables(docs, no_docs):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_lines", "kept_lines"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["kept_lines"] == 2 and rows[6]["text"] == ""
    assert line_dedup.dedup_lines(no_docs).count() == 0


def _shingled(x):
    return {x[i : i + 5] for i in range(len(x) - 4)}


def _jaccard(a, b):
    a, b = _shingled(a), _shingled(b)
    return len(a & b) / len(a | b)


def _near_line(draw, line, low=0.8, high=0.9):
    """``line`` with random letters changed, at a similarity from ``low`` to ``high``."""
    while True:
        new = list(line)
        for at in draw.sample(range(len(line)), draw.randint(1, 1 + len(line) // 40)):
            new[at] = draw.choice("abcdefghijklmnopqrstuvwxyzäß漢")
        if low <= _jaccard(line, "".join(new)) <= high:
            return "".join(new)


def _random_line(draw, n):
    return "".join(draw.choice("abcdefghijklmnop  äß漢") for _ in range(n - 2)).join("xy")


def test_near_lines_of_each_length_are_found(spark):
    draw = random.Random(11)
    for low, high in ((30, 44), (45, 99), (100, 400)):
        lines = [_random_line(draw, draw.randint(low, high)) for _ in range(250)]
        rows = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, _near_line(draw, x)) for i, x in enumerate(lines)]
        found = {r["id"] for r in line_dedup.doubles(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found <= {1000 + i for i in range(250)} and len(found) >= 0.98 * 250, (low, len(found))


def test_links_beside_the_least_line_of_a_band(spark):
    """A family around a common passage: pairs just near whose bands hold many lines just not near, and a chain.

    Telling all such pairs apart takes all pairs of a group, which no step may make; nine in ten have to be found.
    """
    draw = random.Random(12)
    shared = _random_line(draw, 260)
    rows, want = [], set()
    for pair in range(40):
        line = shared + _random_line(draw, 40)
        rows += [(10 * pair, line), (10 * pair + 1, _near_line(draw, line, 0.8, 0.83))]
        want.add(10 * pair + 1)
    chain = _random_line(draw, 200)
    for i in range(12):
        rows.append((5000 + i, chain))
        chain = _near_line(draw, chain, 0.81, 0.9)
    got = {r["id"] for r in line_dedup.doubles(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = {d for d, _ in _slow_drops(rows)}
    assert want <= exact and len(exact) == 40 + 11
    assert got <= exact and len(got) >= 0.9 * len(exact)


def test_rows_that_share_a_key_keep_their_own_text(spark):
    draw = random.Random(13)
    a, b, c, d, e = (" ".join(_random_line(draw, 60) for _ in range(4)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (7, d), (7, e), (7, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect())
    assert kept == sorted([(1, a), (0, b), (0, c), (7, d), (7, e)])
    x, y, z, w = (_random_line(draw, 60) for _ in range(4))
    rows = [(1, x), (None, f"{x}\n{y}"), (None, f"{z}\n{x}"), (7, f"{w}\n{x}"), (7, f"{x}\n\nshort")]
    left = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(1, x), (0, y), (0, z), (7, w), (7, "\nshort")])


def test_signatures_by_hand():
    """Minima of every permutation, counted run by run, for lines of each kind."""
    draw = random.Random(14)
    lines = [_random_line(draw, n) for n in (16, 40, 55, 67, 90, 400)]
    which, bands, sketch = line_dedup.signatures(lines)
    kinds = [(i, 0) for i, x in enumerate(lines) if len(x) - 4 <= line_dedup.SHORT[1]] + [(i, 1) for i, x in enumerate(lines) if len(x) - 4 >= line_dedup.SHORT[0]]
    assert which.tolist() == [i for i, _ in kinds]
    for (i, kind), found, bits in zip(kinds, bands.view(np.uint64).tolist(), sketch.view(np.uint64).tolist(), strict=True):
        slow_bits = 0
        x = line_dedup.runs([lines[i]])[0].tolist()
        assert len(x) == len(lines[i]) - 4
        for band, want in enumerate(found):
            made = 2 * band + kind
            for row in range(line_dedup.ROWS):
                turn, shift = line_dedup._TURNS[band, row].tolist()
                ranks = [(v % 2**32 * turn % 2**32) ^ shift for v in x if not kind or (v >> 32) * line_dedup.ROWS >> 32 == row]
                least = min(ranks, default=2**32 - 1)
                made = (made ^ least) * 0x9E3779B97F4A7C15 % 2**64
                slow_bits |= (least * 0x9E3779B1 % 2**32 >> 31) << (59 - row * line_dedup.BANDS - band)
                made ^= made >> 31
            assert made == want
        assert slow_bits == bits
    same, _ = line_dedup.runs(["abcdefgh", "xabcdefghy"])
    assert set(same[:4].tolist()) < set(same[4:].tolist())


def test_sketches_tell_strangers_but_no_near_lines():
    draw = random.Random(15)
    off = lambda a, b: int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)))
    for n in (20, 30, 60, 64, 120, 500):
        lines = [_random_line(draw, n) for _ in range(150)]
        near = [_near_line(draw, x, 0.8, 0.95) if n > 25 else x for x in lines]
        for kind in [k for k in (0, 1) if (n - 4 <= line_dedup.SHORT[1], n - 4 >= line_dedup.SHORT[0])[k]]:
            a, b = line_dedup._signed(lines, kind)[1], line_dedup._signed(near, kind)[1]
            assert np.mean([off(x, y) <= line_dedup.MOST_OFF for x, y in zip(a, b, strict=True)]) >= 0.99
            assert np.mean([off(x, y) <= line_dedup.MOST_OFF for x, y in zip(a[1:], b, strict=False)]) < 0.2


def test_recall_of_edit_embedding(spark, corpus):
    """Classes against all pairs of fingerprints of the same corpus with edits."""
    draw, texts = random.Random(16), [r["text"] or "" for r in corpus.orderBy("doc_id").limit(150).collect()]
    rows = list(enumerate(texts))
    for i, t in enumerate(texts[:80]):
        new = list(t)
        for _ in range(1 + len(t) // 300):
            at = draw.randrange(len(new) + 1)
            new[at : at + 1] = draw.choice(([], ["x"], ["y", "z"]))
        rows.append((1000 + i, "".join(new)))
    marks = {i: edit_embedding.fingerprint(t) for i, t in rows}
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = [(a, b) for a in marks for b in marks if a < b and edit_embedding.likeness(marks[a], marks[b]) >= 0.8]
    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in edit_embedding.embed_and_link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: find(i) for i in marks}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is linked that is not near
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 60 and sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)


def test_no_link_of_a_band_is_lost(spark):
    """Members that share one band alone, near ones as pairs, chains and stars away from the least one, against all pairs of each band."""
    draw = random.Random(17)
    near = {(i + 150, i) for i in range(1, 120)} | {(400 + i, 399 + i) for i in range(1, 90)} | {(600, i) for i in range(500, 540)}
    sizes = {1: range(300), 2: range(390, 500), 3: range(495, 610), 4: (700, 701, 702), 5: (800,)}
    rows = [(h, band, 5 if h % 2 else 7) for band, hs in sizes.items() for h in hs] + [(10, 1, 7), (11, 1, 5)]
    draw.shuffle(rows)
    truth = spark.createDataFrame(sorted(near | {(702, 701)}), "h long, rep long")

    def check(pairs):
        return pairs.join(truth, ["h", "rep"], "left_semi")

    got = {r["node"]: r["root"] for r in components(banded_links(spark.createDataFrame(rows, "h long, band long, sketch long"), check, 1), "h", "rep").collect()}
    want = {r["node"]: r["root"] for r in components(truth, "h", "rep").collect()}
    assert got == want and len(want) > 350
    # sketches too far apart are not checked at all
    far = {r["node"] for r in components(banded_links(spark.createDataFrame([(1, 1, 0), (2, 1, 15), (3, 1, 14)], "h long, band long, sketch long"), lambda p: p, 1), "h", "rep").collect()}
    assert far == {2, 3}


def _family(draw, passage=180, own=60, pairs=150):
    """Lines around a common passage: a near line stands beside each, the others lie just under the bound."""
    shared, rows = _random_line(draw, passage), []
    for i in range(pairs):
        line = shared + _random_line(draw, own)
        rows += [(2 * i, line), (2 * i + 1, _near_line(draw, line, 0.8, 0.84))]
    return rows


def _dropped_by_all_pairs(rows):
    """Keys of lines that are not the first of their class, over all pairs with a common band, near sketches and a similarity of the bound or more."""
    which, bands, sketch = line_dedup.signatures([x for _, x in rows])
    marks = [[(set(b), s) for w, b, s in zip(which.tolist(), bands.tolist(), sketch.view(np.uint64).tolist(), strict=True) if w == i] for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any(a & b and (x ^ y).bit_count() <= line_dedup.MOST_OFF for a, x in marks[i] for b, y in marks[j]) and _jaccard(rows[i][1], rows[j][1]) >= line_dedup.LEAST:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0] for i in range(len(rows)) if find(i) != i}


def test_every_link_of_a_family_of_lines_is_found(spark):
    rows = _family(random.Random(18))
    want = _dropped_by_all_pairs(rows)
    assert {r["id"] for r in line_dedup.doubles(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want and len(want) > 100


def test_the_pipeline_drops_every_near_line_of_a_family(spark):
    import corpus_pipeline

    rows = _family(random.Random(19))
    want = _dropped_by_all_pairs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) + 0L n_chars")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert left == {k: "" if k in want else t for k, t in rows} and len(want) > 100


def test_lines_just_under_the_bound_are_told_without_their_texts(spark, monkeypatch):
    """A family whose pairs almost all lie under the bound: few pairs are left to the check, and every link is found."""
    draw = random.Random(20)
    rows = _family(draw, 200, 90, 120)
    compared, checked = [], line_dedup._checked

    def count(pairs, texts):
        compared.append(pairs.count())
        return checked(pairs, texts)

    monkeypatch.setattr(line_dedup, "_checked", count)
    got = {r["id"] for r in line_dedup.doubles(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _dropped_by_all_pairs(rows) and len(got) > 90
    assert sum(compared[1:]) < 5 * len(rows)  # after the least line of each band


def test_screens_lose_no_near_pair(spark):
    """Marks of lines and of fingerprints pass every pair at the bound or above, and few well below."""
    draw = random.Random(21)
    lines = [_random_line(draw, n) for n in (16, 20, 30, 60, 200, 1000, 3000) for _ in range(12)] + ["ab" * 40, "abc" * 30, "a" * 50]
    pairs = [(x, y) for x in lines for y in (x, x[: len(x) * 9 // 10], x[: len(x) * 7 // 10], x + x[: len(x) // 5], "é" + x[1:-1], x[:-1] + "zz", lines[0])]
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) >= 5]
    rows = [(line_dedup.parities(a), line_dedup.parities(b), _jaccard(a, b)) for a, b in pairs]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, j double").select("j", line_dedup._may_be_near("a", "b").alias("near")).collect()
    assert all(r["near"] for r in got if r["j"] >= line_dedup.LEAST) and sum(r["near"] for r in got if r["j"] < 0.6) == 0 < sum(r["j"] >= 0.8 for r in got)
    texts = ["", "x", *[_random_line(draw, n) for n in (9, 30, 60, 130, 500, 2000, 2100, 9000) for _ in range(8)]]
    pairs = [(x, y) for x in texts for y in [*[x[: int(len(x) * f)] + "qq" + x[int(len(x) * g) :] for f, g in ((0, 0.02), (0.1, 0.3), (0.5, 0.5), (0.5, 0.55), (0.8, 0.83), (0.99, 1))], x, x[: len(x) * 9 // 10], texts[40]]]
    fps = [(edit_embedding.fingerprint(a), edit_embedding.fingerprint(b)) for a, b in pairs]
    rows = [(edit_embedding.mark(a), edit_embedding.mark(b), edit_embedding.likeness(a, b)) for a, b in fps]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, j double").select("j", edit_embedding._may_be_near("a", "b", 0.8).alias("near")).collect()
    assert all(r["near"] for r in got if r["j"] >= 0.8) and sum(r["j"] >= 0.8 for r in got) > 50
    assert sum(r["near"] for r in got if r["j"] < 0.5) <= 0.2 * sum(r["j"] < 0.5 for r in got)


def test_marks_tell_all_fingerprints_just_under_the_bound(spark):
    """Marks hold all ranges, so pairs that differ in their first ranges too are told."""
    draw, fps = random.Random(22), []
    for _ in range(40):
        text = _random_line(draw, 4000)
        for _ in range(8):
            other = "".join(draw.choice("abcdefgh") for _ in range(300)) + text[300:] if draw.random() < 0.7 else text
            at = draw.randrange(2500)
            fps.append((edit_embedding.fingerprint(text), edit_embedding.fingerprint(other[:at] + _random_line(draw, 800) + other[at + draw.randrange(780, 821) :])))
    rows = [(edit_embedding.mark(a), edit_embedding.mark(b), edit_embedding.likeness(a, b)) for a, b in fps]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, j double").select("j", edit_embedding._may_be_near("a", "b", 0.8).alias("near")).collect()
    assert all(r["near"] for r in got if r["j"] >= 0.8)
    assert sum(r["near"] for r in got if r["j"] < 0.798) <= 0.02 * len(got) and sum(0.7 < r["j"] < 0.8 for r in got) > 20


def test_bands_of_fingerprints():
    """Bands are those of the samples, alike for near fingerprints and seldom for strangers."""
    draw = random.Random(23)
    lines = [_random_line(draw, n) for n in (30, 90, 400, 900, 3000) for _ in range(60)]
    fps = ["", *map(edit_embedding.fingerprint, lines)]
    found = edit_embedding.bands(fps)
    for fp, row in zip(fps, found.tolist(), strict=True):
        want = []
        for back in (0, 1):
            span = max(0, max(2, len(fp) // 64) - 2 - back)
            part = fp[64 * span : 64 * span + 64].ljust(64, "-")
            for i, places in enumerate(edit_embedding._SAMPLED.tolist()):
                made = 64 * i + span
                for p in places:
                    made = made << 5 | (16 if part[p] == "-" else int(part[p], 16))
                want.append(made)
        assert row == want
    sets = [set(r) for r in found.tolist()]
    assert sum(bool(sets[i] & sets[j]) for i in range(241, 301) for j in range(241, i)) <= 0.01 * 60 * 59 / 2


def test_tables_of_the_rounds_go(spark, corpus, tmp_path):
    """What links and lines took is gone once the result is written; what the result reads stays."""
    import os

    from strandline.llm.common import materialise, scratch, shared_dir

    at = shared_dir(spark).split(":", 1)[-1]
    before = set(os.listdir(at))
    rows = edit_embedding.embed_and_link(corpus).count(), line_dedup.dedup_lines(corpus).count()
    assert rows == (corpus.count(),) * 2
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before)
    assert left == ["edit-ids", "edit-neighbours", "line-drops"]
    with scratch() as keep:
        a, b = keep(materialise(spark.range(3), "kept")), materialise(spark.range(4), "gone")
    assert a.count() == 3 and [x for x in set(os.listdir(at)) - before if x.startswith("gone")] == [] and b is not None
