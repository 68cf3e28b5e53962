"""The pipeline against a brute-force version of all its stages, on a small corpus."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from reclink.llm import suffixes

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    """(id, text): near copies, repeated passages and junk; null texts and ids, shared ids, repeated rows."""
    r = random.Random(8)
    stock = [w + v for w in ("thond", "erwh", "anor", "été", "inea", "ouble", "stre", "ung") for v in ("", "ing", "a", "o", "sh", "en", "ti", "el", "ou")]
    text = lambda n: " ".join(r.choice(stock) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))
    base = [text(r.randint(60, 200)) for _ in range(25)]
    near = [b.replace(f" {b.split()[9]} ", " zzz ", 1) for b in base[:6]]
    passage = text(40)
    shared = [f"{text(60)} {passage} {text(60)}" for _ in range(4)]
    private = [f"{text(70)} write to a.b@c-d.org or 10.1.2.3, +44 20 7946 0958 {text(10)}" for _ in range(3)]
    junk = ["spam " * 90, "short", "", "$$ ## ** " * 40, None]
    rows = list(enumerate(base + near + base[:3] + shared + private + junk + [text(1500)]))
    one, two = text(80), text(90)
    rows += [(5, one), (5, two), (5, two), (None, text(70)), (None, base[7]), (None, near[0]), (None, f"{text(60)} {passage} {text(60)}")]
    return rows + [(60, one + " tail"), (61, two), rows[3], rows[3]]


def brute(rows, labelled):
    kept = sorted({(k, t) for k, t in rows if rules_pass(t or "")}, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest()))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if v == old else v for v in root]
    kept = [kept[k] for k in range(len(kept)) if root[k] == k]
    seen, left = set(), []
    for k, t in sorted(kept, key=lambda x: (-(2**63) if x[0] is None else x[0], suffixes.text_mark(x[1].encode()))):
        b, gone = t.encode(), []
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone = [*gone[:-1], (gone[-1][0], i + 100)] if gone and gone[-1][1] >= i else [*gone, (i, i + 100)]
            seen.add(b[i : i + 100])
        if whole := suffixes.whole_characters(b, gone).strip(" ") if gone else t:
            left.append((k, suffixes.whole_characters(b, gone) if gone else t))
            assert whole
    patterns = (("<EMAIL>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("<PHONE>", r"\+[0-9][\x20().0-9-]+[0-9]"), ("<IP>", r"[0-9]+(\.[0-9]+){3}"))
    for tag, pattern in patterns:
        left = [(k, re.sub(pattern, tag, t)) for k, t in left]
    return left


def rules_pass(text):
    w = re.findall(WORD, text)
    runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def pieces_of(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    out = collections.Counter()
    for k, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        out.update((k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return out


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def stored(spark, folder, rows, labels):
    spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_equals_brute_force(spark, tmp_path):
    """Labels without bad documents give no cut, so what the base rules keep is kept."""
    rows = corpus()
    labelled = {k for k, t in rows if k is not None and t and "spam" not in t and "$$" not in t}
    expected = brute(rows, labelled)
    assert 25 < len(expected) < len(rows) - 15
    got = pipeline.run(spark, stored(spark, tmp_path, rows, [(k, 1, 0) for k in labelled] + [(None, 1, 0), (3, None, None)])).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of(expected)


def test_ratio_takes_effect(spark, tmp_path):
    """Bad and toxic documents that pass the base rules go by the likelihood ratios; clean ones stay."""
    r = random.Random(3)
    make = lambda kind: " ".join(f"{kind}{r.randint(0, 400)}" for _ in range(120))
    rows = [(k, make("good") if k % 4 else make("junk") if k % 8 else make("good") + " " + " ".join(f"slur{r.randint(0, 30)}" for _ in range(40))) for k in range(240)]
    labels = [(k, int(k % 4 > 0 or k % 8 == 0), int(k % 8 == 0)) for k in range(160)]
    docs = spark.read.parquet(stored(spark, tmp_path, rows, labels) + "/documents.parquet")
    kept = {x["doc_id"] for x in pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {k for k in range(240) if k % 4}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_nothing_to_keep(spark, tmp_path, rows):
    assert pipeline.run(spark, stored(spark, tmp_path, rows, [])).count() == 0


def test_stages_keep_the_schema(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == pipeline.COLUMNS, name
        ids &= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(ids) > 100
