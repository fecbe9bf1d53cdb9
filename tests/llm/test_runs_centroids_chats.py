"""Periodic runs, centroid clustering and chat formatting against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from matchloom.llm import centroids, chat, periodic_runs

DOCS = "doc_id long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_runs(w, least=6, exponent=4):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if j > i and n >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                out.add((s, n, q))
            i = j + (j == i)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_small_alphabets(least, exponent):
    r = random.Random(exponent)
    for _ in range(1500):
        n = r.randint(0, 40)
        w = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(n)]
        if r.random() < 0.5 and n > 8:
            a, q = r.randrange(n - 7), r.randint(1, 6)
            w = w[:a] + [w[a + i % q] for i in range(n - a)]
        assert periodic_runs.runs_of(w, least, exponent) == brute_runs(w, least, exponent), w


@pytest.mark.parametrize("base", [1, 2, 0])
def test_runs_where_hashes_lie(base):
    """A base under which hashes collide gives extensions that are too long; the words themselves put them right."""
    r = random.Random(base)
    for _ in range(300):
        w = [r.randrange(2) for _ in range(r.randint(6, 60))]
        w += w[-5:] * 4
        words = periodic_runs.Words(w, base)
        n = len(w)
        i, j = sorted(r.sample(range(n), 2))
        k = 0
        while j + k < n and w[i + k] == w[j + k]:
            k += 1
        assert words.ahead(i, j) == k
        k = 0
        while k < i and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        assert words.behind(i, j) <= k


def test_runs_of_long_texts():
    r = random.Random(3)
    root = [r.randrange(9) for _ in range(40)]
    for w, want in (([1] * 100_000, [(0, 100_000, 1)]), ([1, 2] * 50_000 + [1], [(0, 100_001, 2)]), (root * 2500, [(0, 100_000, 40)])):
        got = [x for x in periodic_runs.runs_of(w) if x[1] > 1000]
        assert got == want


def brute_summary(doc_id, text):
    w = [x for x in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    n = len(w)
    if doc_id is not None:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or (n * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = (s, n, q, 1000 * n // q)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_summaries(spark):
    r = random.Random(8)
    pool = ["a", "b", "the", "é", "中", "A", "x\xa0y", " "]
    rows = [(i, " ".join(r.choice(pool[: r.randint(1, 8)]) for _ in range(r.randint(0, 80)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "a b " * 9), (7, "x\ty\x0bz " * 5), (7, "x\ty\x0bz " * 5), (1003, "w" * 100_000), (1004, "k l m n " * 3000)]
    df = spark.createDataFrame([(a, b, 0, "z") for a, b in rows], DOCS + ", runs int, words string")
    got = sorted(map(tuple, periodic_runs.summary(df).collect()), key=str)
    small = [x for x in rows if x[0] != 1004]
    assert [x for x in got if x[0] != 1004] == sorted((brute_summary(*x) for x in small), key=str)
    assert [x[1:6] for x in got if x[0] == 1004][0][0] >= 1
    plain = {x.doc_id: (x.runs, x.collapsed) for x in periodic_runs.find_runs(df.where("doc_id >= 1000")).collect()}
    assert plain[1004] == ([(0, 12000, 4)], "k l m n") and plain[1000] == ([], "") and plain[1003] == ([], "w" * 100_000)
    assert periodic_runs.summary(df.where("false")).count() == 0


VECS = "vec_id long, embedding array<float>"


def brute_clusters(rows, k=16, rounds=3, d=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()]
    seeds = sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for r in range(rounds + 1):
        at = [min((far(v, w), j) for j, w in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, x) in zip(kept, at) if x == j]
                if own:
                    c[j] = [sum(z) // len(own) for z in zip(*own)]
    within = [sum(e for e, x in at if x == j) for j in range(len(c))]
    return sorted(((i, x, e, within[x], sum(within), c[x]) for (i, _), (e, x) in zip(kept, at)), key=str)


@pytest.mark.parametrize("block", [1024, 37])
def test_clusters(spark, block):
    r = np.random.default_rng(5)
    x = r.normal(size=(20, 64))[r.integers(0, 20, 400)] + r.normal(size=(400, 64)) * 0.2
    x[100:250] = x[100]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows[3], rows[4], rows[5], rows[6] = (3, None), (4, [1.0] * 63), (5, [float("inf")] + [0.0] * 63), (6, [None] + [0.0] * 63)
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, [0.0] * 64), (901, [-0.001] * 64)]
    df = spark.createDataFrame([(a, b, 1, [2.0]) for a, b in rows], VECS + ", cluster int, points array<double>").repartition(3)
    got = centroids.cluster(df, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)


def test_clusters_of_few_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECS)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], VECS)).count() == 0
    rows = [(i, [float(i % 3), -float(i)]) for i in range(5)] + [(5, [1e30, -1e30])]
    got = centroids.cluster(spark.createDataFrame([r for r in rows if r[0] < 5], VECS), dimensions=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows[:5], d=2)
    big = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(rows, VECS), k=2, dimensions=2).collect()}
    assert len(big) == 6 and big[5].distance == 0 and big[5].centroid == [1 << 27, -(1 << 27)]


def test_dual_tree_settles_whole_nodes():
    """Apart clusters are settled by nodes, and no point of them is compared by itself."""
    r = np.random.default_rng(1)
    centre = r.integers(-(1 << 20), 1 << 20, (8, 16))
    points = np.unique((centre[r.integers(0, 8, 900)] + r.integers(-20, 20, (900, 16))), axis=0)
    t = centroids.cover_tree(points)
    points = points[t.order]
    assert all((np.sqrt(((points[a:b] - points[c]) ** 2).sum(1)) <= rad * (1 + 1e-12)).all() for a, b, c, rad in zip(t.low, t.high, t.centre, t.radius))
    nodes, of, alone, _ = centroids.descend(points, t, centroids.Centroids(centre))
    assert len(alone) == 0 and len(nodes) < 40 and sum(t.high[nodes] - t.low[nodes]) == len(points)
    assert all((((points[a:b, None] - centre) ** 2).sum(2).argmin(1) == c).all() for a, b, c in zip(t.low[nodes], t.high[nodes], of))


LOG = "conv_id long, message long, seq long, kind string, role string, text string"


@pytest.mark.parametrize("template", [chat.INSTRUCT, chat.CHATML])
def test_texts_come_back(template):
    r = random.Random(2)
    bits = [*template.controls, *(c[:1] for c in template.controls), *(c[1:] for c in template.controls), "\\", "\\\\", "\n", " ", "a", "中", "\U0001f600"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "<s>", "a\nb\\"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 4))]
        out, learnt = "", []
        for role, text in turns:
            turn, start, n = template.render(role, text)
            learnt.append((len(out) + start, n))
            out += turn
        assert list(template.read(out)) == turns
        assert [template.unescape(out[a : a + n]) for a, n in learnt] == [t for _, t in turns]
        assert all(template.escape(t) == t for _, t in turns if not any(c[1:] in t for c in template.controls))
        for _, text in turns:
            assert not any(c in template.escape(text) for c in template.controls)


def test_controls_that_overlap():
    marks = {"user": ("<a>", "<b>")}
    for bad in (("<a>", "<b>", ">x"), ("<a>", "<b>", "a"), ("<a>", "<b>", "<a>b"), ("<a>", "<b>", "aba"), ("<a>",)):
        with pytest.raises(ValueError):
            chat.Template(bad, marks, ("<a>", "<b>", "<a>"))


def fold(log):
    """Final messages of a log, plainly."""
    out = {}
    for conv, number, seq, kind, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2])):
        m = out.setdefault((conv, number), [])
        if kind == "message" or not m:
            m.append(["", "", True])
        now = m[-1]
        if not now[2]:
            continue
        if kind == "message":
            now[0], now[1] = role or "", text or ""
        elif kind == "delta":
            now[0], now[1] = now[0] or role or "", now[1] + (text or "")
        elif kind == "edit":
            now[0], now[1] = role or now[0], text or ""
        elif kind == "regenerate":
            now[0], now[1] = now[0] or role or "", ""
        else:
            now[2] = False
    return {c: [(r, t) for k in sorted(k for k in out if k[0] == c) for r, t, on in out[k] if on] for c in {k[0] for k in out}}


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_logs_are_folded(spark, most):
    r = random.Random(most)
    log = []
    for conv in range(40):
        seq = list(range(r.randint(1, 60) if conv else 800))
        for s in seq:
            kind = r.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"] if s else ["message"])
            log.append((conv, r.randrange(1 + len(seq) // 6), s, kind, r.choice([None, "user", "assistant", "tool"]), r.choice([None, "", "hi ", "<s>", "\\", "</s>[INST]", "ä"])))
    r.shuffle(log)
    want = {c: m for c, m in fold(log).items() if m}
    parts = chat.format_chats(spark.createDataFrame([(*e, 1) for e in log], LOG + ", part int"), most=most).collect()
    got, learnt = {}, {}
    for p in sorted(parts, key=lambda p: (p.conv_id, p.message, p.part)):
        turns = list(chat.INSTRUCT.read(p.formatted))
        assert len(turns) == p.turns and (len(p.formatted) <= most or p.turns == 1)
        got.setdefault(p.conv_id, []).extend(turns)
        learnt.setdefault(p.conv_id, []).extend(chat.INSTRUCT.unescape(p.formatted[s.start : s.start + s.length]) for s in p.loss)
    assert got == want
    assert learnt == {c: [t for role, t in m if role == "assistant"] for c, m in want.items()}


def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "a\n\nb\n"), (1, 0, "user", None), (1, 1, "assistant", "a\n\nb\n"), (1, 2, None, "</s>"), (None, 0, "system", "<\\\\s>"), (2, 5, "user", "only"), (3, None, "assistant", "\r\n x"), (4, 0, "user", "u" * 50_000), (4, 1, "assistant", "v\n" * 30_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.log_of(spark, df))).collect()}
    for conv in (1, 2, 3, 4, None, -1):
        turns = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        if conv == -1:
            turns = [(True, 0, "user", chat.MADE), (True, 1, "assistant", chat.MADE)]
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(learnt), sha(learnt))
        assert g.formatted_chars == sum(len(chat.INSTRUCT.render(x[2], x[3])[0]) for x in turns)
    assert len(got) == 6
    for most in (1 << 20, 10):  # most conversations read where they are rendered, or none
        other = chat.read_back(chat.format_chats(chat.log_of(spark, df), most=1000), ranged=True, most=most)
        assert {r.conv_id: r for r in other.collect()} == got
    with pytest.raises(Exception, match="unknown event"):
        chat.format_chats(spark.createDataFrame([(1, 1, 1, "nudge", "user", "x")], LOG)).collect()
    assert chat.format_chats(spark.createDataFrame([], LOG)).count() == 0
