import math
import zlib

import numpy as np

from postloom.llm import language


def test_held_out_accuracy(documents):
    out = {r.doc_id: r for r in language.predict_languages(documents).collect()}
    labelled = {r.doc_id: r.lang for r in documents.collect()}
    assert out.keys() == labelled.keys()
    held = [d for d in out if out[d].held_out]
    assert held == [d for d in out if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([out[d].lang_pred == labelled[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_labels_are_not_read_in_prediction(documents):
    from pyspark.sql import functions as F
    model = language.train(documents)
    assert language.train(documents).weights.tobytes() == model.weights.tobytes()
    plain = language.predict_languages(documents, model).collect()
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    assert sorted(map(tuple, plain)) == sorted(map(tuple, language.predict_languages(other, model).collect()))


def test_codes():
    for classes in (2, 3, 4, 7, 8, 30):
        code = language.codewords(classes).astype(int)
        apart = [(code[a] != code[b]).sum() for a in range(classes) for b in range(a)]
        assert code.shape[0] == classes and min(apart) >= max(1, 2 ** (classes - 2) if classes <= 7 else 4)


def test_pieces_do_not_change_the_grams(monkeypatch):
    text = "Die Katze, 2 Mäuse und 3 Vögel " * 40
    whole = np.sort(np.concatenate(list(language.grams(text))))
    monkeypatch.setattr(language, "PIECE", 17)
    assert (np.sort(np.concatenate(list(language.grams(text)))) == whole).all()


def test_sample_is_bounded(spark):
    """A language with most rows, one id that a third share, and rows that repeat."""
    rows = [(k, "en", f"text {k}") for k in range(3000)] + [(3, "en", f"other {k}") for k in range(1500)]
    rows += [(k, "fr", f"texte {k}") for k in range(40)] * 2 + [(None, "fr", "x"), (5, None, "y"), (6, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = [tuple(r) for r in language.sample(docs, 100).collect()]
    held = {k for k in range(3000) if zlib.crc32(str(k).encode()) % 5 == 0}
    own = {lang: [t for name, t in got if name == lang] for lang in ("en", "fr")}
    assert len(own["en"]) == 100 and len(set(own["en"])) == 100 and len(got) == len(own["en"]) + len(own["fr"])
    assert sorted(own["fr"]) == sorted(f"texte {k}" for k in range(40) if k not in held)
    assert not {f"text {k}" for k in held} & set(own["en"])
    assert len(language.sample(docs, 10_000).collect()) == 3000 - len(held) + len(own["fr"])


def test_decoding_by_brute_force(documents):
    """Each prediction again, n-gram by n-gram and codeword by codeword."""
    model = language.train(documents)
    bits = model.code.shape[1]

    def margins(text):
        raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        total, n = [0.0] * bits, 0
        for size in language.GRAMS:
            for k in range(len(raw) - size + 1):
                value = size
                for b in raw[k:k + size]:
                    value = (value * 0x01000193 & 0xFFFFFFFF) ^ b
                row = model.weights[(value * 0x9E3779B1 & 0xFFFFFFFF) >> 17]
                total = [t + float(w) for t, w in zip(total, row)]
                n += 1
        return [t / max(n, 1) - b for t, b in zip(total, model.bias)]

    texts = {r.doc_id: r.text for r in documents.collect() if 0 < len(r.text or "") < 600}
    got = {r.doc_id: r for r in language.predict_languages(documents, model).collect()}
    assert len(texts) > 20
    for doc_id, text in texts.items():
        if not any(map(str.isalpha, text)):
            continue
        z = margins(text)
        loss = [sum(t * math.log1p(math.exp(-c * m * language.SHARPNESS)) for t, c, m in zip(model.trust, word, z))
                for word in model.code.astype(int)]
        loss = [x / sum(model.trust) for x in loss]
        odds = [math.exp(min(loss) - x) for x in loss]
        assert got[doc_id].lang_pred == model.languages[loss.index(min(loss))]
        assert math.isclose(got[doc_id].score, max(odds) / sum(odds), rel_tol=1e-3)


def test_edges(spark, edges, nothing):
    out = language.predict_languages(edges).collect()
    assert len(out) == edges.count()
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, -5)} == {"und"}
    kept = language.keep_identified(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 4, 4, 4, 7, 8, 9, 5000, 9000]
    assert language.predict_languages(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert language.predict_languages(unlabelled).first().lang_pred == "und"
