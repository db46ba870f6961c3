import numpy as np
import pyarrow as pa

from riskspan.llm import crf


def test_training_reads_whole_texts(spark):
    """Good and bad documents begin with the same 420 lines; what follows tells them apart."""
    head = "\n".join(f"The heading line {i} of every document." for i in range(420))
    good, bad = "\n".join(["Plain words follow here, as they should."] * 900), "\n".join(["#### || $$ @@ ## || %% !!"] * 900)
    rows = [(i, f"{head}\n{bad if i % 2 else good}\nnumber {i}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(30)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in crf.score(docs, labels).collect()}
    assert all(out[i] < 0.5 if i % 2 else out[i] > 0.5 for i in range(30, 40))
    model = crf.learn(docs, labels)
    q = {r["doc_id"]: r["text"] for r in docs.collect()}
    x, size, first = crf.line_features(pa.array([q[30], q[31]]))
    quality = crf.document_quality(x, size, first, model.weights, model.transition)
    assert np.diff(first).min() == 1321 and quality[0] - quality[1] > 0.3
