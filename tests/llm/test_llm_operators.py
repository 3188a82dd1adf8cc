"""Operators of the subpackage against brute force, and their defined edge cases."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import chat, fingerprints, fixity, html, mixing, near_dedup, packing, quality, suffix_dedup, toxicity

DOCS = "doc_id long, text string, source string, c_0 int, words string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [prose(rng, n) for n in (5, 60, 300, 1200)]
    rows = [(k, t) for k, t in enumerate(base)]
    shared = prose(rng, 40)
    rows += [(10 + k, f"{prose(rng, 30)} {shared}\n{prose(rng, 20)} é中") for k in range(6)]
    rows += [(20, base[2]), (21, base[2]), (22, base[2].replace("w1 ", "W1 ")), (23, base[3] + " tail"), (24, base[3][:4000])]
    rows += [(30, None), (31, ""), (32, " \n\t"), (33, "a"), (33, "a"), (34, "\0" * 120), (35, "x\0" * 70), (36, "\0" * 120 + "é"), (None, base[1]), (40, "ab" * 30_000)]
    return spark.createDataFrame([(i, t, None if i == 33 else f"s{(i or 0) % 3}", 1, "w") for i, t in rows], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in packing.pack(docs, with_ids=True).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids), r.sequence_id))
    for key, text in set(rows_of(docs)):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes()
        pieces = sorted(got[key, len(ids) // 4])
        if rows_of(docs).count((key, text)) == 1:
            assert b"".join(p[2] for p in pieces) == ids
    ids = [p[3] for ps in got.values() for p in ps]
    assert len(ids) == len(set(ids))
    assert packing.pack(empty(spark)).count() == 0


def test_word_ids_equal_whole_text():
    import public_tokenizers

    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abcZÉßıİÿĀ 's'll -_.!<|>\n\t 中12½²ªﬁẞ") for _ in range(rng.randint(0, 30)))
        want = w.tokenizer.encode(text, add_special_tokens=False).ids
        assert w(text) == b"".join(i.to_bytes(4, "little") for i in want)


def without_repeats(rows):
    """The digests of suffix_dedup.covered by comparing every window."""
    rows, owner, want = [(suffix_dedup.NULL_ID if i is None else i, t.encode()) for i, t in rows], {}, []
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            owner.setdefault(t[p : p + 50], i)
    for i, t in rows:
        on = bytearray(len(t))
        for p in range(len(t) - 49):
            if owner[t[p : p + 50]] < i:
                on[p : p + 50] = b"\1" * 50
        spans = sum(1 for p, o in enumerate(on) if o and not (p and on[p - 1]))
        kept = bytes(c for c, o in zip(t, on, strict=True) if not o)
        want.append((None if i == suffix_dedup.NULL_ID else i, len(t), sum(on), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize(("heavy", "limit", "batch"), [(2000, 1 << 20, 2048), (1, 100, 3)])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, heavy, limit, batch):
    """Also with every shared anchor cut further, and with an index that is often dropped."""
    for name, value in (("BUCKET_BYTES", 3000), ("HEAVY", heavy), ("LIMIT", limit), ("BATCH", batch)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(8)  # one passage in ever other surroundings: an anchor with many segments
    core = prose(rng, 14)
    more = [(100 + k, f"{prose(rng, 12)} {core[: 30 + k % 40]} {prose(rng, 12)} {core}") for k in range(60)]
    rows = rows_of(docs) + more
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.covered(table).collect()), key=str) == without_repeats(rows)


def test_suffix_index_of_two_batches(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    rows = sorted(rows_of(docs), key=lambda r: -1 if r[0] is None else r[0])
    want = without_repeats(rows)
    got, folder = [], str(tmp_path / "index")
    for part in (rows[:5], rows[5:14], [], rows[14:]):
        got += [tuple(r) for r in suffix_dedup.extended(spark.createDataFrame(part, "doc_id long, text string"), folder, 4).collect()]
    assert sorted(got, key=str) == want
    sizes = {}
    for r in spark.read.parquet(f"{folder}/generation-3").collect():
        sizes.setdefault(r["shard"], []).append((r.level, r.size))
    for levels in sizes.values():
        n = [s for _, s in sorted(levels)]
        assert all(a > 2 * b for a, b in zip(n, n[1:]))  # levels of like size have merged


def test_suffix_levels_equal_sets():
    rng = random.Random(2)
    index, seen = suffix_dedup.SuffixLevels(), {}
    for batch in range(20):
        words = [bytes(rng.choices(b"ab", k=4)) for _ in range(6)]
        doc = np.array(sorted(rng.randrange(batch, batch + 3) for _ in words))
        for w, d in zip(words, doc.tolist(), strict=True):
            seen[w] = min(seen.get(w, d), d)
        got = index.add(np.array(words, "S4"), doc)
        assert got.tolist() == [seen[w] < d for w, d in zip(words, doc.tolist(), strict=True)]
    assert len(index.levels) <= 6


def test_suffix_pipeline_form(spark, docs):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.covered(empty(spark)).count() == 0


def test_near_dedup_equals_brute_force(spark, docs):
    rows = [(i, t) for i, t in rows_of(docs) if i is not None]
    sets = {}
    for i, t in rows:
        w = tuple(t.encode().lower().split())
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    parent = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    got = near_dedup.classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), parent[r.doc_id], r.doc_id == parent[r.doc_id])
    assert near_dedup.classes(empty(spark)).count() == 0


def hub_family(n: int, hub: int, words: int = 400, seed: int = 3):
    """Copies of one text, each with substitutions of its own, so that most are near the hub only."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for i in range(n):
        own = list(text)
        if i != hub:
            for at in rng.sample(range(words), rng.randint(4, 6)):
                own[at] = f"x{i}x{at}"
        yield i, " ".join(own)


def test_near_dedup_joins_a_hub_family(spark):
    family = list(hub_family(1000, 500))
    sets = [near_dedup.Shingles()(t) for _, t in family]
    near = [100 * (both := len(np.intersect1d(s, sets[500]))) >= 85 * (len(s) + len(sets[500]) - both) for s in sets]
    got = {r.doc_id: r.component_id for r in near_dedup.classes(spark.createDataFrame(family, "doc_id long, text string")).collect()}
    assert sum(near) > 900 and {got[i] for i in range(1000) if near[i]} == {got[500]}


@pytest.mark.parametrize("small, members, share", [(16, 2048, 1024), (1, 8, 3), (50, 2048, 2)])
def test_near_dedup_buckets_are_settled(spark, monkeypatch, small, members, share):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "SHARE", share)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    family = list(hub_family(40, 23, words=200)) + [(100 + i, t) for i, t in hub_family(3, 1, seed=4)]
    sets = {i: near_dedup.Shingles()(t) for i, t in family}
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((want[a], want[b]))
                want = {i: x if c == y else c for i, c in want.items()}
    docs = spark.createDataFrame(family, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.classes(docs).collect()} == want


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    words = [f"w{i}" for i in range(204)]
    far, farther = list(words), list(words)
    for at in range(20, 200, 45):
        far[at] = "far"
    for at in range(10, 200, 20):
        farther[at] = "farther"
    sets = [near_dedup.Shingles()(" ".join(x)) for x in (words, far, farther)]
    alike = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets[1:]]
    assert 0.8 <= alike[0] < 0.85 and alike[1] < 0.8
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((words, far, farther))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {0, 2}
    assert near_dedup.classes(docs).filter("kept").count() == 3


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(4)
    for n in (7, 20, 300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        k = int(len(a) * 0.92)
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 1 << 63, len(a) - k, dtype=np.uint64)]))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.85:
            assert (near_dedup.bands(a) == near_dedup.bands(b)).any()


def test_chat_reads_back(spark):
    rows = [(1, 0, "system", "a\\b <s>"), (1, 1, "user", "[INST] x"), (1, 2, "assistant", "\\<role>\n</s>\n"), (2, 0, "assistant", None), (2, 0, None, "</turn>\n"), (2, 1, "to<role>ol", "y"), (None, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for key in (1, 2, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == key)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert out[key].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (out[key].loss_chars, out[key].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert out[1].valid and not out[2].valid


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(r.taken <= 3 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    total = sum(v[0] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(total) and all(v[1] <= 3 * v[0] + 1e-6 for v in by.values())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(4000).selectExpr("id doc_id", "concat('s', id % 4) source", "repeat('w ', cast(1 + id % 97 as int)) text")
    per = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r.k - r.t) <= 0.01 * r.t for r in per)


def test_mixing_is_the_entropy_optimum(spark):
    """Against a solver of the same problem over single documents in numpy."""
    rng = random.Random(5)
    rows = [(k, f"s{k % 5}", "w " * (rng.randrange(1, 60) ** (1 + k % 3))) for k in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    tilted = 0
    for _, g in out.groupby("source"):
        size, target = g["size"].to_numpy(float), g["target"].iloc[0]
        if target >= mixing.MOST * size.sum() * (1 - 1e-9):
            assert (g["copies"] == mixing.MOST).all()
            continue
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.minimum(mixing.MOST, np.exp(mid * size / size.mean())) * size).sum() < target else (low, mid)
        want = np.minimum(mixing.MOST, np.exp(mid * size / size.mean()))
        assert g["rate"].to_numpy() == pytest.approx(want, abs=2e-6)
        assert (abs(g["copies"] - g["rate"]) < 1).all() and abs(g["taken"].sum() - target) <= size.max()
        tilted += g["rate"].nunique() > 5
    assert tilted >= 2


def test_mixing_edge_cases(spark, monkeypatch):
    """Null ids, one hot size over many salts, columns named like the helpers, a text of a million words."""
    monkeypatch.setattr(mixing, "SALT_ROWS", 3)
    rows = [(None if k % 2 else k, "a" if k % 3 else None, "x y" if k < 300 else f"t{k} " * (k % 7), k, k) for k in range(400)] + [(5, "b", "w " * 1_000_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_id int, __id int")
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all() and out["size"].max() == 1_000_000
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mixed(df).columns == df.columns


LONG = "word goes here, " * 20 + "end."


@pytest.mark.parametrize("page,want", [
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<p>Be.</article><footer>f</footer>", "T & U\nOne two\nBe."),
    (f"<div class='ad'>buy</div><main><p>{LONG}</p><aside>side</aside></main>", LONG),
    (f"<div class=content><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", LONG),
    ("", ""), (None, ""), ("<p", ""), ("<script>x</script><style>y</style>", ""),
    # a script that writes a body, and one without an end
    (f"<article><p>{LONG}</p><script>document.write(\"<body>\"); var secret=1;</script><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><script>var secret='<p>{LONG}</p>'", LONG),
    # formulas are text, drawings are not
    (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> so</p><svg><text>axis</text></svg></article>", f"{LONG} x=2 so"),
    # tags that never end hide nothing
    *[(f"<article><{t}><p>{LONG}</p></article>", LONG) for t in ("button", "select", "svg", "object", "noscript", "video")],
    (f"<head><title>t</title><p>{LONG}", LONG), (f"<head><title>t</title></head><body><article><p>{LONG}</article>", LONG),
    # a form around a whole page is no form to fill in
    (f"<body><form><nav><a href=x>a</a></nav><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><form><label>Your mail</label><input><p>{LONG[:60]}</p></form></article>", LONG),
    (f"<article><header><h1>A title</h1></header><p>{LONG}</p></article>", f"A title\n{LONG}"),
    (f"<article><p>{LONG}</p></article><section class=comments><article class=comment><p>{LONG}</p></article></section>", LONG),
    (f"<!--> <article><p>{LONG}</p><!-- <p>gone</p> --><!-- never closed <p>gone</p></article>", LONG),
])
def test_html(page, want):
    assert html.main_text(page or "") == want


def test_html_cut_changes_labels():
    """Short lines that look like nothing by themselves go with the text around them."""
    page = f"<div><p>{LONG}</p><div>so it is</div><p>{LONG}</p><div>and yet</div><p>{LONG}</p></div><ul>" + "<li><a href=x>one two</a></li>" * 8 + "</ul>"
    found, weights = html.blocks(page), np.array(list(html.PRIOR.values()))
    own, cut = html.odds(found, weights) > 0, html.labels(found, weights)
    assert [b.text for b, o, c in zip(found, own, cut, strict=True) if o != c] == ["so it is", "and yet"]
    assert html.main_text(page) == "\n".join([LONG, "so it is", LONG, "and yet", LONG])


def test_html_takes_long_nested_pages():
    start = time.time()
    for page in ("<div>x" * 170_000, "<p " * 300_000, "<!" * 300_000, "<a '" * 200_000, "<div>so it is</div><p>go on.</p>" * 40_000):
        html.main_text(page)
    assert time.time() - start < 60


def test_html_extract(spark):
    page = f"<nav><a href=x>Home page</a></nav><article><h1>T</h1><p>{LONG}</p></article><footer>foot of it</footer>"
    rows = [(k, f"u{k}", page, "t", 1.5) for k in range(30)] + [(30, None, None, "t", 1.5), (31, "", "", "t", 1.5), (None, "u", page, "t", 1.5), (7, "u7", page, "t", 1.5), (32, "u", "<div>x" * 100_000, "t", 1.5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars double")
    got = {(r.page_id, r.url): r.text for r in html.extract(df).collect()}
    assert html.extract(df).count() == len(rows) and got[7, "u7"] == got[None, "u"] == f"T\n{LONG}" and got[30, None] == got[31, ""] == ""
    none = spark.createDataFrame([], df.schema)
    assert html.extract(none).count() == 0 and html.fit(none).tolist() == list(html.PRIOR.values())
    weights = html.fit(df)
    assert weights.tolist() == html.fit(df.repartition(5)).tolist() and weights.tolist() != list(html.PRIOR.values())


def test_min_cut_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        value = lambda keep: sum(max(0, c) for c, k in zip(costs, keep, strict=True) if not k) + sum(max(0, -c) for c, k in zip(costs, keep, strict=True) if k) + sum(w for i, j, w in ties if keep[i] != keep[j])  # noqa: B023, E731
        best = min(value([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert value(html.min_cut(costs, ties)) == pytest.approx(best)


def test_fingerprints(spark, docs):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(fingerprints.with_next(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    want = []
    for k, (i, t) in enumerate(rows):
        e = fingerprints.edited(t, rows[(k + 1) % len(rows)][1])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(t)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.with_next(empty(spark)).count() == 0


def test_quality(spark, docs):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines) for r in quality.measures(docs).collect()}
    for i, t in rows_of(docs):
        w = t.split() if "\x1c" not in t else []
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        on = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else set()
        lines = [x for x in t.split("\n") if x.strip()]
        assert (i, len(w), len(on), len(lines) - len(set(lines))) in got
    assert quality.verdicts(quality.measures(empty(spark))).count() == 0


def test_toxicity_learns_stems():
    rng = random.Random(8)
    rows = []
    for k in range(300):
        words = prose(rng, 60).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumb" + rng.choice(["le", "lo", "er", "ix", "ak", "ul"]) + rng.choice("abcdef"))
        rows.append((" ".join(words), int(k % 3 == 0)))
    scorer = toxicity.Scorer(*toxicity.train(rows[:240]))
    z = [(scorer(t), y) for t, y in rows[240:]]
    assert sum((s > 0.5) == bool(y) for s, y in z) >= 0.9 * len(z)
    assert scorer(prose(rng, 50) + " grumbozo") > scorer(prose(rng, 50))


def test_toxicity_reads_long_words_to_their_end():
    rng = random.Random(9)
    rows = []
    for k in range(300):
        words = prose(rng, 60).split()
        if k % 3 == 0:
            words[20:20] = ["grumbleta", "grumblexo", "grumbleri"]
        rows.append((" ".join(words), int(k % 3 == 0)))
    scorer = toxicity.Scorer(*toxicity.train(rows))
    clean = "".join(prose(rng, 80).split())
    assert len(clean) > 200
    toxic = clean + "grumbletagrumblexogrumbleri" + "".join(prose(rng, 20).split())
    assert scorer(toxic) > 0.5 > scorer(clean)
    core = toxicity.marked(toxic)
    pieces = [p[1:] for p in toxicity.units(toxic)]
    assert all(any(core[i : i + 5] in p for p in pieces) for i in range(len(core) - 4))
    assert pieces[-1].endswith(">") and toxicity.units("a" * 198) == ["a" * 198] and len(toxicity.units("a" * 199)) > 1


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "score", "predicted"]
    assert out.filter("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    assert toxicity.score(empty(spark), toxicity.train([])).count() == 0


PAGES = "page_id long, url string, html string, digest string, v int"


def record_of(url, html):
    body = (html or "").encode()
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_fixity_finds_the_damage(spark):
    """Places against a layout in plain Python, kinds against a comparison of all records; ids of either sign, a null id."""
    rows = [(k * 37 - 9000, f"u{k}", "x" * (k % 301) + "é", "d", 1) for k in range(500)] + [(None, None, None, "d", 1), (9_000_000_000_000, "far", "y" * 200_000, "d", 1)]
    a = fixity.laid_out(spark.createDataFrame(rows, PAGES))
    at, place = {}, {}
    for i, u, h, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        v = (fixity.NO_ID if i is None else i) >> fixity.VOLUME_BITS
        place[i] = (v, at.get(v, 0), len(record_of(u, h)))
        at[v] = at.get(v, 0) + place[i][2]
    assert {r.page_id: (r.volume, r.offset, r.length) for r in a.collect()} == place
    changed, moved, missing = {-9000, 9_000_000_000_000, rows[77][0]}, {rows[5][0], rows[300][0]}, {rows[6][0], rows[400][0]}
    i = F.col("page_id")
    b = a.filter(i.isNull() | ~i.isin(missing)).withColumns({
        "html": F.when(i.isin(changed), F.concat(F.lit("!"), F.substring("html", 2, 1 << 20))).otherwise(F.col("html")),
        "offset": F.when(i == rows[300][0], F.col("offset") + 1_000_000).when(i.isin(moved), F.col("offset") + 1).otherwise(F.col("offset")),
    })
    extra = spark.createDataFrame([(-5, "new", "z", 0, 77, 5)], "page_id long, url string, html string, volume long, offset long, length long")
    want = {(k, kind, *place[k]) for kind, ids in (("changed", changed), ("moved", moved), ("missing", missing)) for k in ids} | {(-5, "extra", 0, 77, 5)}
    got = [(r.page_id, r.kind, r.volume, r.offset, r.length) for r in fixity.audit(a, b.unionByName(extra)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert fixity.audit(a, a.repartition(7)).count() == 0


def test_fixity_edges(spark):
    none = fixity.laid_out(spark.createDataFrame([], PAGES))
    assert fixity.audit(none, none).count() == 0
    twice = fixity.laid_out(spark.createDataFrame([(1, "u", "h", "d", 1), (1, "u", "h", "d", 1), (-1, "u", "h", "d", 1)], PAGES))
    assert twice.count() == 3 and fixity.audit(twice, twice).count() == 0
    assert [(r.page_id, r.kind) for r in fixity.audit(twice, twice.dropDuplicates()).collect()] == [(1, "changed")]
    assert {(r.page_id, r.kind) for r in fixity.audit(none, twice).collect()} == {(1, "extra"), (-1, "extra")}


def test_packing_buckets(spark, docs, tmp_path):
    """Each bucket is a folder with its lengths alone and a range of sequence ids; ids do not depend on the split."""
    pieces = packing.pack(docs, with_ids=True)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    rows = back.collect()
    assert len(rows) == pieces.count() and all(r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in rows)
    ends = [(min(ids), max(ids)) for _, ids in sorted({b: [r.sequence_id for r in rows if r.bucket == b] for b in {r.bucket for r in rows}}.items())]
    assert len(ends) > 5 and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    key = lambda rows: sorted((str(r.doc_id), r.start, r.ids_crc32, r.doc_tokens, r.sequence_id) for r in rows)
    assert key(rows) == key(packing.pack(docs.repartition(9)).collect())


def test_word_ids_of_another_tokenizer():
    import public_tokenizers

    w = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not w.by_words and packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).by_words
    for text in ("Two  words\n and CAPITALS", "", " x"):
        assert w(text) == b"".join(i.to_bytes(4, "little") for i in w.tokenizer.encode(text, add_special_tokens=False).ids)


def test_word_caches_hold_short_words_only():
    import public_tokenizers

    w, s = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), near_dedup.Shingles()
    text = "a " + "b" * 5000 + " " + "é" * 300 + "!" * 300 + " c"
    assert w(text) == b"".join(i.to_bytes(4, "little") for i in w.tokenizer.encode(text, add_special_tokens=False).ids)
    assert s(text).tolist() == s(text).tolist() and len(s(text)) == 1
    assert all(len(x) <= 64 for cache in (w.known, w.letters, s.known) for x in cache)


def plain_digest(text):
    """The quartile digest by its definition, one window after the other."""
    data, counts = text.encode(), [0] * 128
    for k in range(len(data) - 4):
        x = data[k : k + 5]
        for (a, b, c), m in zip([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)], [2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233], strict=True):
            counts[((x[a] + (x[b] << 8) + (x[c] << 16)) * m % (1 << 32)) >> 25] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    codes = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    body = "".join(f"{sum(codes[k + j] << 2 * j for j in range(4)):02x}" for k in range(0, 128, 4))
    return f"{min(255, round(8 * np.log2(len(data) + 1))):02x}{15 * q1 // q3 if q3 else 0:x}{15 * q2 // q3 if q3 else 0:x}{body}", codes, (q1, q2, q3), len(data)


def test_fingerprints_against_plain_digest():
    rng = random.Random(12)
    texts = ["", "a", "abcd", "abcde", "é" * 40, prose(rng, 30), prose(rng, 400), prose(rng, 400) + " tail", "x" * 3000]
    for a in texts:
        fa, ca, qa, na = plain_digest(a)
        assert fingerprints.digest(a) == fa
        for b in texts:
            fb, cb, _, nb = plain_digest(b)
            gaps = [abs(x - y) for x, y in zip(ca, cb, strict=True)]
            ends = sum(2 * abs(int(fa[i:j], 16) - int(fb[i:j], 16)) for i, j in ((0, 2), (2, 3), (3, 4)))
            want = 1.0 if fa == fb else max(0.0, 1 - (sum(gaps) + 3 * gaps.count(3) + ends) / fingerprints.FAR)
            assert fingerprints.likeness(fa, fb) == pytest.approx(want) and fingerprints.likeness(fa, fb) == fingerprints.likeness(fb, fa)
    near, far = fingerprints.likeness(fingerprints.digest(texts[6]), fingerprints.digest(texts[7])), fingerprints.likeness(fingerprints.digest(texts[6]), fingerprints.digest(prose(rng, 400, 40)))
    assert near > 0.8 > far


def test_toxicity_scores_by_definition():
    """A score is the best run's mean over its words of the mean over their buckets, squashed."""
    rng = np.random.default_rng(3)
    numbers, bias = rng.normal(size=toxicity.BUCKETS).astype(np.float32), -0.3
    scorer = toxicity.Scorer(numbers, bias)
    for text in ("", "one", "Two, words!", prose(random.Random(2), 37) + " ÉTÉ --- " + "z" * 450):
        words = toxicity.units(text)
        means = [np.mean([float(numbers[b]) for b in toxicity.buckets(w)]) for w in words]
        runs = [np.mean(means[k : k + toxicity.RUN]) for k in range(0, len(means), toxicity.RUN)] or [0.0]
        assert scorer(text) == pytest.approx(1 / (1 + np.exp(-(max(runs) + bias))), abs=1e-9)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    hit, n, wrong, clean = out.agg(F.sum(F.expr("toxic * predicted")), F.sum("toxic"), F.sum(F.expr("(1 - toxic) * predicted")), F.sum(F.expr("1 - toxic"))).first()
    assert n > 50 and hit >= 0.6 * n and wrong <= 0.03 * clean


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_pipeline_on_the_tables(spark):
    """Each stage against its own input: what stays, what goes, and that other columns come out as they were."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.col("doc_id") * 2 for c in ("score", "predicted", "judged_toxic", "row_no", "mix_id", "__id")})
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns and clean.filter("score <> doc_id * 2 OR predicted <> doc_id * 2 OR judged_toxic <> doc_id * 2").count() == 0
    gone = {r.doc_id for r in docs.join(clean, "doc_id", "left_anti").collect()}
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet")))
    assert gone == {r.doc_id for r in scored.filter("predicted = 1").collect()}
    one = stages["near_dedup"](spark, clean, d)
    kept = {r.doc_id for r in near_dedup.classes(clean, 80).filter("kept").collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(kept)
    thin = stages["suffix_dedup"](spark, one, d)
    want = {r[0]: r[4] for r in without_repeats(sorted(rows_of(one)))}
    assert thin.columns == docs.columns and thin.count() == len(want)
    whole = {r.doc_id: r.text for r in one.collect()}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in thin.collect() if whole[r.doc_id].isascii())
    mixed = stages["mixing"](spark, thin, d)
    copies = {r.doc_id: r.copies for r in mixing.mix(thin).collect() if r.copies}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counted == copies
    final = stages["packing"](spark, mixed, d)
    assert final.agg(F.sum("length")).first()[0] == sum(r.doc_tokens * copies[r.doc_id] for r in packing.pack(thin.filter(F.col("doc_id").isin(*copies))).filter("start = 0").collect())


def test_pipeline_run(spark, tmp_path):
    """run() over small tables with nulls, repeated ids and names of helpers gives the packed pieces of what stays."""
    rng = random.Random(21)
    rows = [(k, prose(rng, 80), f"s{k % 3}", 1) for k in range(40)] + [(None, prose(rng, 30), None, 1), (None, None, "s0", 1), (3, prose(rng, 50), "s1", 1), (50, "", "s2", 1), (51, "ab" * 30_000, "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    got = out.collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.doc_tokens for r in got if r.doc_id == 51} and len({r.doc_tokens for r in got if r.doc_id == 3}) <= 2


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (None, c), (None, c), (None, b), (None, None), (4, None)]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "").collect()
    texts = [r.text for r in got]
    assert sorted(map(str, texts)) == sorted(map(str, [a, b, c, None, None])) or sorted(map(str, texts)) == sorted(map(str, [a + " x", b, c, None, None]))


def test_near_dedup_of_many_copies(spark, monkeypatch):
    """Frequent sets and labels are joined apart; the result is that of the plain joins."""
    monkeypatch.setattr("tidemill.llm.common.HOT_KEYS", 2)
    rng = random.Random(41)
    texts = [prose(rng, 30, 9000) for _ in range(6)]
    rows = [(k, texts[0] if k % 2 else texts[1 + k % 5]) for k in range(400)]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: first[t] for i, t in rows}
