"""Personal data: base spans against the plain patterns, and the bootstrap."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from llm_tables import prose, write_documents
from tillpoint.llm import personal_data as pii

# The plain patterns of the four kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        worth = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(w - 9 * (w > 9) for w in worth) % 10 == 0
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m[0])]


def check(rows, texts):
    own = sorted((str(i), ",".join(brute(t or ""))) for i, t in texts)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == [
        (i, hashlib.sha256(s.encode()).hexdigest()) for i, s in own]
    for r in rows:
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([s for s in r.spans.split(",") if s and not s.startswith("id:")])


HARD = ["a@b.c_d@e.f x@y@z.w a@b.c.d. @a.b a@b", "1.2.3.4.5.6.7.8 300.1.2.3 0001.002.03.4 1.2.3 1..2.3.4.5 256.1.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 4111111111111111000 5500005555555559 1 2 3 4", "+1 (329) 555-7030",
        "+1() +49.30 123456 +1-- 5 ++123456789 +12345678901234567 +1 2 3 4 5 6 7 8 )", "mail é\U0001f600a.b@c.de, 10.0.0.1\U0001f600+4989123456",
        "1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8", "a" * 5000 + "@" + "b." * 5000 + "c", "9" * 3000, "1." * 3000, "", "no data"]


def test_hard_texts(spark, tmp_path):
    texts = dict(enumerate(HARD))
    check(pii.op7_pii(spark, write_documents(spark, tmp_path, texts)).collect(), texts.items())


def test_random_texts(spark, tmp_path):
    rnd = random.Random(5)
    texts = {k: "".join(rnd.choice("ab1234567890.. --+@(é\n") for _ in range(rnd.randint(1, 400))) for k in range(400)}
    check(pii.op7_pii(spark, write_documents(spark, tmp_path, texts)).collect(), texts.items())


def test_odd_documents(spark, tmp_path):
    sf = write_documents(spark, tmp_path)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(pii.op7_pii(spark, sf).collect(), texts)


def test_empty_table(spark, tmp_path):
    assert pii.op7_pii(spark, write_documents(spark, tmp_path, {})).count() == 0


def test_labels_of_known_entities_find_unseen_ones(spark):
    """Phone numbers follow 'tel:', some without the plus sign that the format
    asks for; 'see:' precedes plain numbers and once a phone number."""
    texts = {k: f"{prose(k, 15)} tel: +49 30 55512{k:02d} end" for k in range(10)}
    texts |= {20 + k: f"{prose(k, 15)} Tel: 030-55598{k:02d}. end" for k in range(4)}
    texts |= {40 + k: f"see: 1234567{k} version: 2 {prose(k, 9)}" for k in range(9)} | {60: "see: +49 30 5551234"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start: s.end] for s in r.id] for r in pii.find(docs).collect()}
    assert all(got[20 + k] == [f"030-55598{k:02d}"] for k in range(4))
    assert not any(v for k, v in got.items() if not 20 <= k < 24)


def test_rounds_carry_confidence_through_shared_instances(spark):
    rows = [("tel:", f"t{k}", 1, 1) for k in range(5)] + [("tel:", f"u{k}", 1, 0) for k in range(3)]
    rows += [("fax:", f"u{k}", 1, 0) for k in range(3)] + [("page:", f"p{k}", 1, 0) for k in range(9)]
    edges = spark.createDataFrame(rows, "label string, token string, n long, seeds long")
    one = {r.label: r.confidence for r in pii.scored_labels(edges, rounds=1).collect()}
    three = {r.label: r.confidence for r in pii.scored_labels(edges, rounds=3).collect()}
    assert set(one) == {"tel:"} and abs(one["tel:"] - 5 / 8) < 1e-9
    assert three["tel:"] > one["tel:"] and three["fax:"] > 0.5 and "page:" not in three


def test_native_plan(spark):
    plan = pii.op7_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert spark.range(1).select(F.lit(1)).count() == 1
