import random

import corpus_pipeline


def test_stage_drops_copies_from_80_percent_on(spark):
    """The near-dedup stage equals a comparison of all pairs at 0.8, down to sets of five and four shingles."""
    rng = random.Random(11)
    texts = []
    for g in range(120):
        words = [f"g{g}w{i}" for i in range(rng.choice([9, 9, 14, 29, 60, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(2):
            size = len(words) - 4
            copy = words[: len(words) - rng.randint(size // 7, size // 4)]
            texts.append(" ".join(copy) if rng.random() < 0.5 else " ".join([*copy, f"new{len(texts)}"]))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    alike = lambda a, b, percent: 100 * len(a & b) >= percent * len(a | b)
    least = list(range(len(texts)))
    for _ in range(3):  # groups hold three texts each
        for i in range(len(texts)):
            for j in range(i - i % 3, i - i % 3 + 3):
                if alike(sets[i], sets[j], 80):
                    least[i] = least[j] = min(least[i], least[j])
    between = sum(alike(sets[i], sets[j], 80) and not alike(sets[i], sets[j], 85) for i in range(len(texts)) for j in range(i - i % 3, i))
    assert between > 40 and any({len(sets[i]), len(sets[j])} == {4, 5} and alike(sets[i], sets[j], 80) for i in range(len(texts)) for j in range(i - i % 3, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(least))
