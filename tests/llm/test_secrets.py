import hashlib
import re
from dataclasses import replace

from chronoscope.llm import secrets

KINDS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
TRICKY = [
    'secret=token : "abcdefgh"', "token=abc passwd=abcdef", "API_KEY: 'x.y/z=+-_' apikey=\"123456\"", "AKIAAKIA" + "A" * 20 + " AKIA123", "deadbeef" * 3 + "g" + "0" * 23,
    "é\U0001f600 password = éabcdef password=abcdefé", "tokentoken==abcdefg", "SeCrEt:::aaaaaa secret: aaaaaa", "password=" + "f0" * 20, "", "token=12345 token=123456token=99",
]


def brute(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["spans"] == spans, r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        for kind, *_ in KINDS:
            assert r[f"n_{kind}"] == spans.count(f"{kind}:")


def test_tricky(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check(secrets.secrets_of_documents(docs).collect(), dict(enumerate(TRICKY)))


def test_documents(documents, texts):
    check(secrets.secrets_of_documents(documents).collect(), texts)


def test_ledger_is_incremental(spark):
    one = spark.createDataFrame([(1, "token=aaaaaaaa"), (2, "nothing")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "token=aaaaaaaa"), (3, "passwd: bbbbbbbb"), (4, "token=aaaaaaaa")], "doc_id long, text string")
    versions = lambda d: d.withColumn("blob", secrets.blob_of(d["text"])).select("blob", "text")
    ledger = secrets.scan(versions(one)).cache()
    assert ledger.count() == 2 * len(secrets.RULES)
    # only the new blob, under each rule
    fresh = secrets.scan(versions(two), ledger=ledger).collect()
    assert len(fresh) == len(secrets.RULES) and len({r["blob"] for r in fresh}) == 1
    # a new version of one rule: every blob again, but under that rule alone
    raised = (replace(secrets.RULES[0], version=2), *secrets.RULES[1:])
    again = secrets.scan(versions(one), raised, ledger).collect()
    assert {(r["kind"], r["version"]) for r in again} == {("assign", 2)} and len(again) == 2
    # findings come back to every path, whether scanned now or before
    found = {r["doc_id"]: r["spans"] for r in secrets.secrets_of_documents(two, ledger=ledger).collect()}
    assert found == {1: "assign:0:14", 3: "assign:0:16", 4: "assign:0:14"}


def test_deliveries_scan_each_blob_once(documents, texts, monkeypatch):
    """The second delivery touches only blobs that the first has not held; together they give the same."""
    ledgers, real = [], secrets.scanned

    def counted(*args):
        ledgers.append(real(*args))
        return ledgers[-1]

    monkeypatch.setattr(secrets, "scanned", counted)
    copies = documents.unionByName(documents.withColumn("doc_id", documents["doc_id"] + 100_000))
    check(secrets.secrets_by_deliveries(copies).collect(), texts | {k + 100_000: t for k, t in texts.items()})
    n = [x.count() for x in ledgers]
    first, second = ({t or "" for (t,) in d.select("text").collect()} for d in secrets.deliveries(copies))
    assert n == [len(secrets.RULES) * len(first), len(secrets.RULES) * len(first | second)] and first & second and second - first
    assert ledgers[1].select("blob", "kind").distinct().count() == n[1]


def test_edges(edge_docs, no_docs):
    by_ledger = {(r["doc_id"], r["spans"]) for r in secrets.secrets_by_deliveries(edge_docs).collect()}
    assert by_ledger == {(r["doc_id"], r["spans"]) for r in secrets.secrets_of_documents(edge_docs).collect()}
    assert secrets.secrets_by_deliveries(no_docs).collect() == []
    rows = secrets.secrets_of_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    eleven = next(r for r in rows if r["doc_id"] == 11)
    assert (eleven["n_assign"], eleven["n_access"], eleven["n_hex"]) == (1, 1, 1)
    five = next(r for r in rows if r["doc_id"] == 5)
    assert five["spans"] == "" and five["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.secrets_of_documents(no_docs).collect() == []
