"""Text operators on small tables: contracts, edge cases, brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import automaton, html_text, line_dedup, packing, quality, simhash, substring_dedup, toxicity

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i}" for i in range(3000))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (4, LONG), (5, LONG + " tail"), (6, "one"), (7, "é È 中文 \U0001f600"), (None, "no id here at all, but a line of some length"), (8, "a line of some length\nA LINE OF SOME LENGTH \nx"), (9, "a line of some length")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_lines_by_hand(spark):
    out = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, EDGE)).collect()}
    assert (8, 3, 0, "a line of some length\nA LINE OF SOME LENGTH \nx") in out
    assert (9, 1, 1, "") in out
    assert (1, 1, 0, "") in out and (2, 1, 0, "") in out
    assert (None, 1, 0, "no id here at all, but a line of some length") in out
    assert [x for x in out if x[0] == 4] == [(4, 1, 0, LONG)]


def brute_lines(rows):
    strip, keys = " \t\n\x0b\x0c\r", {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(strip).translate(lower)
            if len(k) >= 10 and d is not None:
                keys.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(k := x.strip(strip).translate(lower)) >= 10 and len(keys[k]) >= 2 and d > min(keys[k]) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    pool = [" Some Longer Line %d" % i for i in range(12)] + ["short", "", "É ligne assez longue", "\tsome longer line 3 "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)]
    got = sorted((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted(brute_lines(rows))


def test_lines_keep_other_columns_and_take_a_threshold(spark):
    rows = [(1, "the same long line", "a"), (2, "the same long line", "b"), (3, "another long line!", "c"), (4, "the same long line", "d")]
    d = frame(spark, rows, DOCS + ", _pos string")
    out = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(d.withColumnRenamed("_pos", "extra")).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 1}
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(d.withColumnRenamed("_pos", "extra"), min_documents=4).collect()) == 0


def test_empty_tables(spark):
    d = frame(spark, [])
    assert line_dedup.dedup_lines(d).count() == 0
    assert simhash.near_duplicates(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert automaton.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert html_text.extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0


def brute_windows(rows, n=13):
    first, words = {}, []
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        words.append((d, w))
        for i in range(len(w) - n + 1 if d is not None else 0):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1 if d is not None else 0):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept))
    return out


def key(x):
    return (x[0] is None, *x[:0], str(x))


def test_windows_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    passages = [[f"p{j}_{i}" for i in range(r.randint(5, 40))] for j in range(6)]
    rows = list(EDGE)
    for d in range(20, 90):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.6 else [f"u{r.randint(0, 50)}" for _ in range(r.randint(1, 30))]
        rows.append((d, r.choice([" ", "\n", " \t"]).join(w)))
    for parts in (1, 5):
        got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(frame(spark, rows).repartition(parts)).collect()]
        assert sorted(got, key=key) == sorted(brute_windows(rows), key=key)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 64)
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(frame(spark, rows).repartition(4), pass_bits=4).collect()]
    assert sorted(got, key=key) == sorted(brute_windows(rows), key=key)
    digest = substring_dedup.remove_repeats(frame(spark, rows), digest=True).collect()
    assert sorted((x.doc_id or -1, x.kept_sha256) for x in digest) == sorted((d or -1, sha(k)) for d, _, _, k in brute_windows(rows))


def test_windows_survive_small_flushes(spark, monkeypatch):
    passage = " ".join(f"q{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(40)]
    out = substring_dedup.remove_repeats(frame(spark, rows).repartition(7)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {0: 0, **{i: 30 for i in range(1, 40)}}
    assert all([(s.first, s.end) for s in r.spans] == [(2, 32)] for r in out if r.doc_id)


def test_packed_windows_round_trip():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 1 << 63, 500, dtype=np.uint64))
    for docs in (r.integers(-5, 5, 500), r.integers(-(1 << 62), 1 << 62, 500)):
        a, b, c = substring_dedup.unpack_windows(substring_dedup.pack_windows(h, np.arange(500).astype(np.uint8), docs))
        assert (a == h).all() and (b == np.arange(500).astype(np.uint8)).all() and (c == docs).all()


def brute_fingerprint(t):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints():
    for _, t in EDGE:
        assert simhash.simhash(t) == brute_fingerprint(t)


@pytest.mark.parametrize("most", [0, 2, 64])
def test_simhash_links_reach_all(spark, most):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:25]:
        for _ in range(4):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {1 << 63, 0, (1 << 63) | 1}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    from matchloom.llm.components import components

    got = {x.node: x.component for x in components(simhash.links(d, most), "a", "b").collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: find(i) for i in range(len(fps))}


def test_simhash_rows(spark):
    out = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, EDGE)).collect()}
    assert {x for x in out if x[1] == 0} == {(1, 0, 1), (2, 0, 1), (3, 0, 1)}
    assert {x[2] for x in out if x[0] in (4, 5)} == {4}
    kept = [r.doc_id for r in simhash.one_of_each(frame(spark, EDGE)).collect()]
    assert None in kept and 5 not in kept and 2 not in kept and kept.count(4) == 2


def test_encoder_matches_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    e, r = packing.BulkEncoder(path), random.Random(3)
    letters = "abcAB. ,'sÉΣİ́Jǰ̌ \n\t\xa0\x1c-_9中<|>"
    import pyarrow as pa

    from matchloom.llm.words import text_buffers

    for i in range(400):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(3)] + ["x<|endoftext|>z <|ENDOFTEXT|>"] * (i % 40 == 0)
        ids, cuts = e.encode(*text_buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_exact_and_gapless(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    rows = [*EDGE, *((100 + i, " ".join("word%d" % r.randint(0, 999) for _ in range(r.randint(0, 900)))) for i in range(60))]
    rows = [(i if d is None else d * 1000 + i, t) for i, (d, t) in enumerate(rows)]
    out = packing.pack(frame(spark, rows).repartition(3), path, ids=True).collect()
    t = Tokenizer.from_file(path)
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows}
    got, sequences = {}, {}
    for p in sorted(out, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(got.setdefault(p.doc_id, [])) and p.length == len(p.ids) and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id] += p.ids
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    waste = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste < 4096 * 3 * 2


def plain_differencing(sizes, k):
    """The largest differencing method on whole k-tuples of windows."""
    parts = sorted(([s] + [0] * (k - 1) for s in sizes), key=lambda p: p[-1] - p[0])
    while len(parts) > 1:
        a, b = parts[0], parts[1]
        new = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        rest, at = parts[2:], 0
        while at < len(rest) and rest[at][0] - rest[at][-1] >= new[0] - new[-1]:
            at += 1
        parts = [*rest[:at], new, *rest[at:]]
    return parts[0]


def test_differencing_is_near_equal():
    r = random.Random(1)
    sizes = [r.randint(1, 1000) for _ in range(400)]
    w = packing.differencing(sizes, 40)
    total = [sum(sizes[i] for i in x) for x in w]
    assert sorted(i for x in w for i in x) == list(range(400)) and max(total) - min(total) < 60
    assert all(sum(sizes[i] for i in x) <= 4096 for x in packing.windows_of(sizes, 4096))
    assert packing.plan([], 4096, 1024) == []
    for k in (1, 2, 3, 7, 30):
        # distinct spreads, so that no tie decides
        sizes = [2**i + 3**i for i in range(20)]
        assert sorted((sum(sizes[i] for i in x) for x in packing.differencing(sizes, k)), reverse=True) == [x for x in plain_differencing(sizes, k) if x]


def test_many_tiny_documents():
    lengths = [1] * 100_000 + [3] * 30_000
    pieces = packing.plan(lengths, 4096, 1024)
    assert len(pieces) == len(lengths) and max(p[3] for p in pieces) + 1 == -(-sum(lengths) // 4096)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_cancel_out_in_polynomial_hashes(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, w = Tokenizer.from_file(path), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pairs = [(x, x.translate(str.maketrans("ab", "ba"))) for x in map(thue_morse, (1024, 2048, 4096))]
    texts = [x for p in pairs for x in (*p, " ".join(p))]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    assert {r.doc_id: r.ids for r in automaton.encode_documents(docs, path).collect()} == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    got = {}
    for p in sorted(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True).collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(p.ids)
    assert got == {i: [*w.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(i, f"{x} {passage}") for i, x in enumerate(texts[:2] + texts[3:5])]
    assert [r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()] == [0] * 4


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from matchloom.llm import words

    monkeypatch.setattr(words.Lanes, "hashes", lambda self: self.lengths.astype(np.uint64))
    data = np.frombuffer(b"ab cd ab ef abc xyz abc 0123456789 0123456780 0123456789", np.uint8)
    table = words.WordTable(6)
    for _ in range(2):
        lanes = words.Lanes(data, *words.spans(data, np.zeros(0, np.int64)))
        starts, stops = words.spans(data, np.zeros(0, np.int64))
        ids, ends = table.gather(lanes, lambda which: [np.array([starts[i], int.from_bytes(data[starts[i] : stops[i]].tobytes()[-3:])], "<u4").tobytes() for i in which.tolist()])
        assert [int(ids[e - 1]) for e in ends] == [int.from_bytes(data[a:b].tobytes()[-3:]) for a, b in zip(starts.tolist(), stops.tolist())]


def test_automaton_matches_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    a, t, r = automaton.Automaton(path), Tokenizer.from_file(path), random.Random(8)
    letters = "aaabbcet hinos'  \n\t.,!<|>0129é中\x85\xa0 \x1c\U0001f600s"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a" * 501, " " * 300, "x<|endoftext|>y", "", LONG]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert a.encode(x) == ids and a.decode(ids) == t.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in automaton.round_trip(frame(spark, EDGE), path).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == sha("") and rows[7].decoded_sha256 == sha(EDGE[7][1])
    both = automaton.decode_documents(automaton.encode_documents(frame(spark, EDGE), path), path)
    assert sorted(r.text for r in both.collect()) == sorted(t or "" for _, t in EDGE)


PAGE = (
    "<html><head><title>T</title><script>var x='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><header><h1>Title &amp; more</h1></header>"
    "<p>Short.</p><p>One <i>two</i><br>three&nbsp;four &lt;b&gt;<ul><li>item</li></ul><div class='comments'><p>nice post</p></div><aside>see also</aside><form><p>Subscribe</p></form><footer>by x</footer></article>"
    "<div id=cookie-notice>We use cookies</div><div class=sidebar><p>" + "the of and " * 30 + "</p></div><footer>&copy; c</footer>"
)


def test_html_by_hand(spark):
    assert html_text.extract(PAGE) == "Title & more\nShort.\nOne two three four <b>\nitem"
    body = "This is the story of a man who went to the sea and back again. " * 4
    plain = f"<div><a href=a>Home</a> | <a href=b>News</a></div><div><h2>Head</h2><p>{body}</p><p>Yes.</p><p>{body}</p></div>"
    assert html_text.extract(plain) == f"Head\n{body.strip()}\nYes.\n{body.strip()}"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (None, "u", PAGE), (4, "u", "<p '" * 20000)]
    out = {(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert (1, "", 0) in out and (2, "", 0) in out and (3, "plain text", 10) in out and any(x[0] is None and x[2] > 0 for x in out)


def labelled(spark, n=900):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        w = ["".join(r.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scum"])
        text = " ".join(x + r.choice(["$$$", "###"]) for x in w) if bad else " ".join(w)
        rows.append((i, text, len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs = frame(spark, [*rows, (n, None, None), (n + 1, "", 0), (None, "a b c", 5)], "doc_id long, text string, n_chars long")
    return docs, frame(spark, [*labels, (0, None, None), (n + 5, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(out, labels, name):
    y = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    held = [(r.predicted, y[r.doc_id]) for r in out if r.held_out and r.doc_id in y]
    return sum(a == b for a, b in held) / len(held)


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 903 and all(0 <= r.score <= 1 for r in out) and accuracy(out, labels, "quality") > 0.97
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    none = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    twice = quality.score(docs.union(docs), quality.train(docs, labels.union(labels))).collect()
    assert len(twice) == 1806 and {(r.doc_id, r.score) for r in twice} == {(r.doc_id, r.score) for r in out}


def test_factorisation_identity():
    m, r = quality.Machine(20, 3), np.random.default_rng(0)
    m.w, m.v = r.normal(size=20), r.normal(size=(20, 3))
    which, value = np.array([2, 5, 9, 11]), r.normal(size=4)
    got = m.raw(np.zeros(4, int), which, value, 1)[0][0]
    pairs = sum(m.v[which[i]] @ m.v[which[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(got, m.w[which] @ value + pairs)


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    docs = docs.union(docs.where("doc_id < 20"))
    model = toxicity.train(docs.where("doc_id IS NULL OR doc_id >= 0").dropDuplicates(), labels.union(labels.where("doc_id < 40")))
    out = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(out) == 923 and accuracy(out, labels, "toxic") > 0.97 and all(0 <= r.score <= 1 for r in out)
    assert len({(r.doc_id, r.score) for r in out}) == 903
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.score(docs.limit(0), model).count() == 0
    # only the calibration fold has both kinds, or only the others have
    for fold in ("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 1", "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) > 1"):
        assert toxicity.score(docs, toxicity.train(docs, labels.where(fold))).count() == 923


def plain_words(text):
    """Words in plain code: runs of letters and marks, of Chinese letters pairs."""
    out = []
    for run in re.findall(r"[一-鿿]+|[^\W\d_一-鿿]+", (text or "").lower()):
        out += ([run[i : i + 2] for i in range(len(run) - 1)] or [run]) if "一" <= run[0] <= "鿿" else [run]
    return out


def plain_models(train):
    """Both class models in plain code: probabilities of a word by class, with the words that any text has."""
    n = [{}, {}]
    for text, y in train:
        for w in set(plain_words(text)):
            n[y][w] = n[y].get(w, 0) + 1
    size, seen = [sum(c.values()) for c in n], set(n[0]) | set(n[1])
    both = {w: n[0].get(w, 0) + n[1].get(w, 0) for w in seen}

    def discount(y, w):
        odds = toxicity.OFTEN * size[y] / size[1 - y]
        return toxicity.ALONE + both[w] * odds / (1 + odds)

    left = [sum(min(c, discount(y, w)) for w, c in n[y].items()) / size[y] for y in (0, 1)]
    p = lambda y, w: max(n[y].get(w, 0) - discount(y, w), 0) / size[y] + left[y] * both[w] / sum(size) if w in seen else left[y]
    return p, seen, np.log(left[1] / left[0])


def toxic_rows(spark, n=60):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "m", "ü", "st"]) for _ in range(r.randint(1, 3)))
    return [(" ".join(word() for _ in range(40)) + (" bakelostümmbast bakelostümmbast 坏人 ab" if i % 3 == 0 else " bakelostümmlost 好人 ab"), int(i % 3 == 0)) for i in range(n)], word


def test_toxicity_against_plain_models(spark):
    train, word = toxic_rows(spark)
    p, seen, base = plain_models(train)
    assert np.allclose([sum(p(y, w) for w in seen) for y in (0, 1)], 1)
    counts = toxicity.count_words(spark.createDataFrame([(t, y, 2 + i % 3) for i, (t, y) in enumerate(train)], "text string, y int, fold int").repartition(5))
    assert counts.count() == len(seen)
    rows, got_base = toxicity.ratios(counts)
    model = toxicity.Model((rows, got_base))
    texts = [" ".join(word() for _ in range(50 * i)) + " BAKELOSTÜMMBAST x bakelostümmlost9坏人好人 ab" for i in range(4)] + ["", "9 !", "中文字", "坏人", "bakelostümmbast"]
    assert [plain_words(t) for t in texts[-3:]] == [["中文", "文字"], ["坏人"], ["bakelostümmbast"]]
    words = toxicity.Words(texts)
    assert np.bincount(words.row, minlength=len(texts)).tolist() == [len(plain_words(t)) for t in texts]
    # the words differ after their eighth code point only, and none of the texts' words is left out of the mean
    got = toxicity.evidence(model.table, texts)
    for x, t in zip(got, texts, strict=True):
        each = np.array([np.log(p(1, w) / p(0, w)) - base for w in plain_words(t)])
        size = min(len(each), toxicity.PASSAGE)
        best = max((each[i : i + size].mean() for i in range(len(each) - size + 1)), default=0.0) if size else 0.0
        assert np.allclose(x, [each.mean() if size else 0.0, best])
    one = lambda w: toxicity.evidence(model.table, [w])[0, 0]
    assert np.isclose(got_base, base) and one("bakelostümmbast") > 0.5 > -0.01 > one("bakelostümmlost") and one("坏人") > 0.5 and one("ab") == 0
    # ratios too many to broadcast: the same measures through a join
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, texts[0]])], DOCS)
    few = {r.doc_id: r[1:] for r in toxicity.evidence_rows(docs, model, "doc_id").collect()}
    model.table = None
    many = {r.doc_id: r[1:] for r in toxicity.evidence_rows(docs, model, "doc_id").collect()}
    assert few.keys() == many.keys() and all(np.allclose(few[i], many[i]) for i in few) and few[0][1] > 0


def test_toxicity_learns_from_all_folds_and_texts_alike(spark):
    train, _ = toxic_rows(spark)
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == toxicity.CALIBRATION_FOLD]
    fold = set(ids)
    docs = [(i, t) for i, (t, _) in enumerate(train)]
    # a word that only the calibration fold's texts have, and one that a single text repeats
    docs = [(i, t + (" schlimmesding" if y and i in fold else "") + (" immerwieder" * 50 if i == 3 else "")) for (i, t), (_, y) in zip(docs, train, strict=True)]
    labels = frame(spark, [(i, y) for i, (_, y) in enumerate(train)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, DOCS), labels)
    assert toxicity.evidence(model.table, ["schlimmesding"])[0, 0] > 0 == toxicity.evidence(model.table, ["immerwieder"])[0, 0]
    # classes of equal size still tell
    half = [(t, y) for t, y in train if y] + [(t, y) for t, y in train if not y][:20]
    rows, base = toxicity.ratios(toxicity.count_words(spark.createDataFrame([(t, y, 2) for t, y in half], "text string, y int, fold int")))
    even = toxicity.Model((rows, base))
    assert abs(base) < 0.2 and toxicity.evidence(even.table, ["bakelostümmbast"])[0, 0] > 0.2 and toxicity.evidence(even.table, ["bakelostümmlost"])[0, 0] < -0.2


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "a line that two documents share", "p", 1, 2.0), (2, "a line that two documents share\nand another one", "q", 2, 3.0), (None, None, None, None, None)]
    d = frame(spark, rows, "doc_id long, text string, _drop string, n_words int, x0 double").withColumn("fp", F.lit(7)).withColumn("component_id", F.lit("c")).withColumn("_h1", F.lit(1)).withColumn("y", F.lit(5))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert (out[2].n_dropped, out[2].kept_text, out[2]._drop, out[2]._h1) == (1, "and another one", "q", 1)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(d).collect()}
    assert (out[2].n_words, out[2]._drop, out[2].fp) == (9, "q", 7)
    assert simhash.one_of_each(d).columns == d.columns and simhash.one_of_each(d).count() == 3
    labels = frame(spark, [(1, 1), (2, 0)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns and {r.x0 for r in kept.collect()} == {2.0, 3.0, None}


def test_html_marked_inline_elements_end_with_their_tag():
    body = "This is a long enough sentence of the article that has all the words in it which one would look for. " * 2
    p = f"<p>{body}</p>"
    t = body.strip()
    whole = f"T\n{t}\n{t}"
    for mark in ('<span class="share">x</span>', '<i class="fa fa-comment" aria-hidden="true"></i>', '<small role="note" class="ad">x</small>', '<span class="share"><span>x</span>y</span>', '<em class="promo">x<b>y</b></em>'):
        assert html_text.extract(f"<article><h1>T</h1>{mark}{p}{p}</article>") == whole
        assert html_text.extract(f"<body><h1>T</h1>{mark}{p}{p}</body>") == whole
        assert html_text.extract(f"<article><h1>T</h1><p>{mark} {body}</p><p>{body}{mark}</p></article>") == whole
    # text around a mark is one block, the mark's own is out
    assert html_text.extract(f'<article><h1>T</h1><p>{body}<span class="notice">not this</span>{body}</p></article>') == f"T\n{t} {t}"
    # what a marked inline element holds stays out, blocks included
    assert html_text.extract(f'<article><h1>T</h1>{p}<span class="share"><div>{body}</div><span>a</span>{body}</span>{p}</article>') == whole
    # closed inside a block that began in it
    assert html_text.extract(f'<article><h1>T</h1><i class="share"><div>x</i>{p}</div>{p}</article>') == whole


def test_html_articles_in_containers_out_by_class():
    body = "This is a long enough sentence of the article that has all the words in it which one would look for. " * 2
    p, t = f"<p>{body}</p>", body.strip()
    assert html_text.extract(f'<body><div class="layout-with-sidebar"><div class="menu">{p}</div><article><h1>T</h1>{p}<div class="share">{p}</div></article></div></body>') == f"T\n{t}"
    # not those in more such containers than another one, nor those out by element or role
    assert html_text.extract(f'<div class="layout-with-sidebar"><article>{p}</article><div class="comments"><article>{p}{p}</article></div></div>') == t
    assert html_text.extract(f"<article>{p}</article><aside><article>{p}{p}</article></aside>") == t


def test_html_in_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<a " * 350_000, '<a "' * 250_001 + ">", "<a '> '" * 100_000, "</a " * 200_000 + "x>", "<!-- " * 100_000, "<script>" * 100_000):
        html_text.extract(page)
    assert time.perf_counter() - began < 10
    assert html_text.extract("text <!-- open") == "text" and html_text.extract("<p>a</p><script>var x = 1") == "a" and html_text.extract("<svg/><p>hello</p>") == "hello"
    assert html_text.extract("<p title='it>first</p><p>second</p>") == "first\nsecond"


@pytest.mark.parametrize("piece", ["<p>a</p>", "<div><b>x</b>", "<span class=ad>x</div>", "<span class=ad>x<p>y", "<td>x<tr>", "<i hidden>x<div>", "<p>some short text</p>"])
def test_html_of_many_blocks_in_linear_time(piece):
    import time

    for start in ("", "<article>"):
        took = []
        for n in (8_000, 80_000):
            began = time.perf_counter()
            html_text.extract(start + piece * n)
            took.append(time.perf_counter() - began)
        assert took[0] < 2 and took[1] < 20 * max(took[0], 0.1)


def plain_labels(page):
    """Both passes of the rules, block by block and looking at all others."""
    found = [(b, t) for b in html_text.blocks(page) if (t := html_text.clean(b))]
    fewest = [b.depth for b, _ in found if b.article and not b.out]
    out = [b.out or bool(b.article and fewest and b.depth > min(fewest)) for b, _ in found]
    first = []
    for (b, t), gone in zip(found, out, strict=True):
        words = html_text.WORD.findall(t.lower())
        stops = sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words))
        if gone or (fewest and not b.article) or (b.links / len(t) > html_text.LINK_SHARE and not b.heading):
            first.append(False)
        else:
            first.append(True if (len(t) >= html_text.SHORT and stops >= html_text.STOP_SHARE) or len(t) >= 4 * html_text.LONG else None)
    kept = []
    for i, (b, t) in enumerate(found):
        label = first[i]
        if label is None:
            decided = [(abs(i - j), not first[j]) for j in range(len(found)) if first[j] is not None and not (fewest and (out[j] or found[j][0].article != b.article))]
            label = not min(decided)[1] if decided else (bool(b.article) if fewest else not b.links)
        if label:
            kept.append(t)
    return "\n".join(kept)


def test_html_rules_beside_plain_ones():
    r = random.Random(4)
    good = "The cat and the dog were in the house with a bird that sang for them all day"
    dull = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore"
    bits = [f"<p>{good}</p>", f"<p>{dull}</p>", f"<p>{dull * 8}</p>", "<p>short one</p>", "<h2>Heading</h2>", "<p><a href=x>many links only here</a></p>", '<p>a <a href="x">b</a></p>', "<div class=sidebar><p>side</p></div>", "<nav>menu</nav>", "<article>", "</article>", "<div>", "</div>", "<div class='layout sidebar'>"]
    changed = 0
    for _ in range(3000):
        page = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert html_text.extract(page) == plain_labels(page), page
        changed += "short one" in page and "short one" not in html_text.extract(page)
    assert changed > 100


def test_html_without_marks():
    """Pages that mark nothing: density finds the article, neighbours its short blocks."""
    r = random.Random(9)
    words = "the of and to in that is was for on with as by at from which were are this have had not but they".split()
    text = lambda n: " ".join(r.choice(words) if r.random() < 0.45 else r.choice(["house", "river", "market", "people", "winter", "engine", "letter", "story"]) for _ in range(n))
    right = wrong = missed = 0
    for _ in range(40):
        body = [(r.choice(["p", "div"]), text(r.randint(20, 60))) for _ in range(r.randint(4, 9))]
        body[r.randrange(1, len(body) - 1)] = ("p", "Short words.")
        links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(n)) + "</ul>"
        page = f"<html><body>{links(6)}<div>" + "".join(f"<{tag}>{t}</{tag}>" for tag, t in body) + f"</div>{links(5)}<div><a href=x>Imprint</a> <a href=y>Contact</a></div></body></html>"
        got, want = html_text.extract(page).split("\n"), [t for _, t in body]
        right += sum(len(x) for x in got if x in want)
        wrong += sum(len(x) for x in got if x not in want)
        missed += sum(len(x) for x in want if x not in got)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95
