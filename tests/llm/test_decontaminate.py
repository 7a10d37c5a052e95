"""The latent space is fitted on every passage of every document."""

import numpy as np

from skerry.llm import decontaminate


def test_all_passages_of_all_documents_are_fitted(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 400, 12)) for _ in range(6)]
    known = sorted({w for t in items for w in t.split()})
    texts = [" ".join(rng.choice([*known, *(f"x{i}" for i in range(4000))], 150)) for _ in range(3000)] + [None, ""]
    seen = {}

    def fitted(gram, *args, fit=decontaminate.gram_space):
        seen.update({r.word: dict(zip(r.words, r.weights)) for r in gram.collect()})
        seen["n"] = args[0]
        return fit(gram, *args)

    monkeypatch.setattr(decontaminate, "gram_space", fitted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decontaminate.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    vocabulary = {w: i for i, w in enumerate(known)}
    df = np.array([sum(w in set((t or "").split()) for t in texts) for w in known])
    idf = np.where(df <= 0.01 * len(texts), np.log((len(texts) + 1.0) / (df + 1.0)), 0.0)
    for t in items:
        own = np.unique([vocabulary[w] for w in t.split()])
        rare = own[np.argsort(df[own], kind="stable")[:8]]
        idf[rare] = np.maximum(idf[rare], np.log((len(texts) + 2.0) / (df[rare] + 1.0)))
    want = np.zeros((len(known), len(known)))
    for t in texts:
        words = (t or "").split()
        for lo in range(0, len(words), 64):
            x = np.zeros(len(known))
            for w in words[lo:lo + 64]:
                if w in vocabulary:
                    x[vocabulary[w]] += idf[vocabulary[w]]
            if x.any():
                x /= np.linalg.norm(x)
                want += np.outer(x, x)
    assert seen.pop("n") == len(known)
    got = np.zeros_like(want)
    for i, row in seen.items():
        got[i, list(row)] = list(row.values())
    assert np.trace(want) > 2048 and np.allclose(got, want)
