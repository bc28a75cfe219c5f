import random
import re
from collections import Counter

from chronoscope.llm import decontaminate as dc


def words_of(text):
    return [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]


def runs_of(w):
    return Counter(" ".join(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([" ".join(w)])


def brute(docs, items):
    """Every window of the item's size."""
    items = {k: words_of(t) for k, t in items if words_of(t)}
    weight = Counter(r for w in items.values() for r in runs_of(w))
    out = {}
    for doc_id, text in docs:
        w = words_of(text)
        for item, iw in items.items():
            own = runs_of(iw)
            for a in range(max(1, len(w) - len(iw) + 1)):
                window = w[a:a + len(iw)]
                if not window:
                    continue
                theirs = runs_of(window)
                common = sum(min(n, theirs[r]) / weight[r] for r, n in own.items())
                whole = sum(n / weight[r] for r, n in own.items()) + sum(n * (1 / weight[r] if r in own else 1) for r, n in theirs.items())
                s = common / (whole - common)
                if s >= 0.8 - 1e-9:
                    out[doc_id, item] = max(out.get((doc_id, item), 0), round(s, 9))
    return out


def test_planted_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: f"w{r.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 14, 30, 59, 40])]
    items += [(6, items[3][1] + " " + word()), (7, ""), (8, None), (9, "Mixed CASE, and; punctuation - here it is!")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(90))]
        if i % 2:
            p = (r.choice(items)[1] or "").split(" ")
            for _ in range(r.randrange(3)):
                p[r.randrange(len(p))] = word()
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if i % 4 == 1 else x for x in p]
        docs.append((i, " ".join(w)))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["similarity"] for x in got} == brute(docs, items)


def test_items_of_one_template_and_short_documents(spark):
    """Documents that hold an item's own text without the long template all items share."""
    template = [f"t{i}" for i in range(200)]
    own = [[f"o{k}_{i}" for i in range(60)] for k in range(40)]
    items = [(k, " ".join(template + w)) for k, w in enumerate(own)]
    docs = [(k, " ".join(w)) for k, w in enumerate(own)]
    want = brute(docs, items)
    assert len(want) == 40
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["similarity"] for x in got} == want


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one"), (None, "one"), (2, "no id but some words here to see"), (3, ""), (4, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(edge_docs, items).collect()}
    assert got == {(8, 1), (8, 4), (None, 2)}
    left = dc.without_contaminated(edge_docs, items)
    assert left.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted([1, 2, 2, 3, 4, 5, 6, 7, 9, 10, 11, -5])
    assert dc.contaminated(no_docs, items).collect() == []
    assert dc.contaminated(edge_docs, items.limit(0)).collect() == []
