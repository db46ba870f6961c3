"""op2: the models' spans against a plain Python model, and texts whose tokens or matches are very many or very long."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from riskspan.llm import secrets


def plain_ratios(tokens):
    counts = {True: Counter(), False: Counter()}
    for token, label in tokens:
        for a, b in zip("\0" + token, token, strict=False):
            counts[label][ord(a), ord(b)] += 1
    total = {k: Counter() for k in counts}
    for k, c in counts.items():
        for (a, _), n in c.items():
            total[k][a] += n
    return lambda a, b: math.log2((counts[True][a, b] + 0.5) / (total[True][a] + 32)) - math.log2((counts[False][a, b] + 0.5) / (total[False][a] + 32))


def plain_markov(text, ratio, base):
    out = []
    for m in re.finditer(secrets.TOKEN, text):
        bits = sum(ratio(ord(a), ord(b)) for a, b in zip("\0" + m[0], m[0], strict=False)) / len(m[0])
        if bits > max(secrets.THRESHOLD, secrets.BITS / len(m[0])) and not any(s < m.end() and m.start() < e for s, e in base):
            out.append((m.start(), m.end()))
    return out


def test_markov_spans_equal_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_ones = [f"see {''.join(rng.choices(letters, k=rng.randint(8, 40)))} and {'x' * 20}1 ümlaut 🙂 {''.join(rng.choices(letters, k=24))}" for _ in range(60)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(random_ones)], "doc_id long, text string"))
    chosen = secrets.samples(docs).collect()
    ratio = plain_ratios([(r["token"], r["random"]) for r in chosen])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found, n = secrets.scan(docs).collect(), 0
    for r in found:
        base = [(s["start"], s["end"]) for k in secrets.KINDS[:3] for s in r[k]]
        got = [(s["start"], s["end"]) for s in r["markov"]]
        assert got == plain_markov(texts[r["doc_id"]], ratio, base)
        n += len(got)
    assert n > 50


def test_letters_alone_and_short_tokens_are_compared(spark):
    """Random strings of letters alone, and of twelve characters, are found; words, long compounds and plain numbers are not."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "information Donaudampfschifffahrtsgesellschaft configuration_settings 9914969043960559 understanding"
    labelled = [("".join(rng.choices(letters, k=24)), True) for _ in range(2_000)]
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plain = secrets.samples(corpus).where("not random").select("token", "random")
    ratios = secrets.train(plain.unionByName(spark.createDataFrame(labelled, "token string, random boolean")))
    docs = [(k, f"use {''.join(rng.choices(letters[:52], k=24))} or {''.join(rng.choices(letters, k=12))} now") for k in range(200)]
    docs.append((-1, words))
    found = {r["doc_id"]: len(r["markov"]) for r in secrets.find(spark.createDataFrame(docs, "doc_id long, text string"), ratios).collect()}
    assert found.pop(-1) == 0
    assert sum(found.values()) >= 0.9 * 2 * len(found)


def test_long_tokens_and_many_matches_take_seconds(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long = "".join(rng.choices(letters, k=1_000_000))
    many = " ".join(f"token={''.join(rng.choices(letters, k=24))} {''.join(rng.choices(letters, k=20))} ü" for _ in range(20_000))
    docs = spark.createDataFrame([(-1, long), (-2, many), (-3, "plain words"), (-4, None)], "doc_id long, text string")
    began = time.perf_counter()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, ratios=[1.0] * 128**2).collect()}
    assert time.perf_counter() - began < 60
    assert clean[-1] == "[SECRET]" and clean[-3] == "plain words" and clean[-4] is None
    assert clean[-2].count("token=") == 0 and clean[-2].count("ü") == 20_000


def test_masking_equals_plain_masking(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("abü🙂 c", k=rng.choice([3, 40, 900, 5_000])))
        at = [rng.randrange(len(text)) for _ in range(rng.randint(1, 30))]
        rows.append((i, text, sorted((a, min(len(text), a + rng.randint(1, 9))) for a in at)))
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,end:int>>")
    got = {r["id"]: r["m"] for r in df.select("id", secrets._masked(df["text"], df["spans"], "#").alias("m")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        assert got[i] == out + text[at:]


def test_held_out_precision_and_recall(spark):
    """Three quarters of the labelled samples train the models, the rest are told apart; names of code from elsewhere are left alone."""
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labelled = secrets.materialise(secrets.samples(corpus), "labelled")
    fold = F.pmod(F.xxhash64("token"), F.lit(4)) == 0
    ratios = secrets.train(labelled.where(~fold))
    held = labelled.where(fold).where("length(token) >= 8").withColumn("i", F.monotonically_increasing_id())
    held = secrets.materialise(held, "held")
    docs = held.where("token rlike '^[A-Za-z0-9+/_-]+$'").select(F.col("i").alias("doc_id"), F.col("token").alias("text"))
    found = secrets.find(docs, ratios).select("doc_id", (F.size("markov") + F.size("hex") + F.size("access") > 0).alias("flag"))
    n = held.join(found, held["i"] == found["doc_id"]).groupBy("random", "flag").count().collect()
    n = {(r["random"], r["flag"]): r["count"] for r in n}
    right, wrong, lost = n[True, True], n.get((False, True), 0), n.get((True, False), 0)
    assert right > 1_000 and n[False, False] > 5_000
    assert right / (right + wrong) >= 0.95 and right / (right + lost) >= 0.95


def test_names_of_code_are_no_secrets(spark):
    names = """MAX_CONNECTIONS_PER_HOST src/main/java/com/example/service getElementByIdFromDocument kwargs_defaultdict_items
        2024-01-15/12-30 abcdefghijklmnopqrstuvwxyz XMLHttpRequest __init_subclass__ utf8mb4_unicode_ci sha256sum_base64_encode
        org/apache/hadoop/mapreduce/JobContext HttpServletRequestWrapper node_modules/lodash/fp/placeholder aws_s3_bucket_policy_v2
        TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256 x86_64-linux-gnu application/x-www-form-urlencoded DEFAULT_MAX_RETRIES 9914969043960559 555-3824"""
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ratios = secrets.train(secrets.materialise(secrets.samples(corpus), "labelled"))
    rng = random.Random(6)
    keys = ["".join(rng.choices(a, k=n)) for a in secrets.ALPHABETS for n in (20, 24, 32) for _ in range(100)]
    rows = [(k, t) for k, t in enumerate(keys)] + [(-1 - k, t) for k, t in enumerate(names.split())]
    found = secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()
    assert not [r for r in found if r["doc_id"] < 0 and r["markov"]]
    assert sum(bool(r["markov"] or r["hex"]) for r in found if r["doc_id"] >= 0) >= 0.97 * len(keys)
