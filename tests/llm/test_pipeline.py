"""The corpus pipeline, stage by stage against plain code."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .test_text import brute_fingerprint, brute_lines, brute_windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(folder, spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "st"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(700):
        w = [word() for _ in range(r.randint(20, 150))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(5):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scum"])
        lines = [" ".join(w[k : k + 15]) for k in range(0, len(w), 15)]
        if i % 5 == 0:
            lines.append("a line that many documents share")
        if i % 7 == 0:
            lines.insert(1, passage)
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1] + " extra") for i in range(30)] + [(2000, None), (2001, ""), (2002, docs[3][1])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return labels


def test_empty_tables_null_ids_and_clashing_names(spark, tmp_path):
    d = str(tmp_path)
    names = "doc_id long, text string, lang string, source string, n_chars long, y int, fp long, kept_text string, __evidence_0 double, h long"
    line = "a line of the kind that more than one document holds, with thirteen words and some more"
    rows = [(1, line, "en", "s", 1, 1, 2, "k", 0.5, 3), (2, line + "\nother", "en", "s", 1, 1, 2, "k", 0.5, 3), (None, line, "en", "s", 1, 1, 2, "k", 0.5, 3), (None, None, None, None, None, None, None, None, None, None), (3, None, "en", "s", 0, 1, 2, "k", 0.5, 3)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).count() == 0
        docs = stage(spark, docs, d)
        assert docs.columns == COLUMNS
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    assert sorted(((r.doc_id or 0), r.text or "") for r in docs.collect()) == [(0, ""), (0, line), (1, line), (2, "other"), (3, "")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    labels = dict((i, y) for i, _, y in corpus(tmp_path, spark))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "substring_dedup", "packing"]

    def through(name, df):
        out = stages[name](spark, df, d)
        assert out.columns == COLUMNS
        out.write.parquet(f"{d}/{name}")
        return spark.read.parquet(f"{d}/{name}")

    one = through("toxicity", docs)
    kept = {i for i, _ in pairs(one)}
    assert sum(i in kept for i, y in labels.items() if y) < 0.1 * sum(labels.values())
    assert sum(i not in kept for i, y in labels.items() if not y) < 0.02 * len(labels)
    two = through("line_dedup", one)
    assert sorted(pairs(two)) == sorted((a, t) for a, _, _, t in brute_lines(pairs(one)))
    three = through("simhash", two)
    rows = pairs(two)
    fp = [brute_fingerprint(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    assert sorted(pairs(three)) == sorted(x for x in rows if find(x[0]) == x[0])
    four = through("substring_dedup", three)
    want = {i: t for i, t in pairs(three)}
    assert sorted(pairs(four)) == sorted((a, t if gone else want[a]) for a, _, gone, t in brute_windows(pairs(three)))
    five = stages["packing"](spark, four, d).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {(p.doc_id, p.doc_tokens) for p in five} == {(i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in pairs(four)}
    assert corpus_pipeline.run(spark, d).count() == len(five)
