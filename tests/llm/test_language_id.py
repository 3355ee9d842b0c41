import random
import zlib

import corpus_pipeline as C
import numpy as np
from edges import check_edges, documents

from ridgeline.llm import language_id as L
from ridgeline.llm.common import is_held_out


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right)
    assert right >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_brute_force_encoding():
    e = L.Encoder(dim=64)
    text = "Ab, çd"
    s = [0, 1, 2, 0, int(e.symbol[ord("ç")]), 4, 0]
    want = np.zeros(64)
    for a, b, c in zip(s, s[1:], s[2:]):
        want += np.roll(e.letters[a], 2).astype(int) * np.roll(e.letters[b], 1) * e.letters[c]
    assert np.allclose(e.encode(text), want / np.linalg.norm(want), atol=1e-6)
    assert e.encode("123 \U0001f600 ...") is None and e.encode("") is None and e.encode(None) is None
    assert e.encode("\U00010400") is not None  # a letter beyond the basic plane


def test_edges(spark):
    docs = documents(spark)
    protos = L.learn_prototypes(docs.filter(~is_held_out("doc_id")))
    rows = {r.doc_id: r for r in check_edges(spark, lambda d: L.predict_languages(d, protos))}
    for i in (3, 4, 5, 6):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in L.predict_languages(docs, {}).collect()} == {"und"}
    kept = L.keep_known_languages(docs, protos, least=-1.0)
    assert kept.columns == docs.columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert L.learn_prototypes(documents(spark, [])) == {}


def test_partitioning_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = L.learn_prototypes(docs.repartition(1)), L.learn_prototypes(docs.repartition(7))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_unlearned_languages_and_noise_go(spark):
    sf, rnd = "/root/testdata/sf0.01", random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", *("".join(map(chr, range(*r))) for r in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00)))]
    strange = ["".join(rnd.choice(a) if rnd.random() > 0.15 else " " for _ in range(n)) for a in alphabets for n in (300, 2000, 10000) for _ in range(10)]
    strange += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。" * 2,
    ]
    mixed = docs.unionByName(spark.createDataFrame([(-1 - k, t, None, None, None) for k, t in enumerate(strange)], docs.schema))
    kept = {r.doc_id for r in C.known_languages(spark, mixed, sf).collect()}
    assert [strange[-1 - d][:40] for d in kept if d < 0] == []
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
