"""The corpus pipeline on a small folder of tables, stage by stage."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

UPPER = {c: c + 32 for c in range(65, 91)}
VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for i in range(900)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, gone int, mark string"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic words, copies, near copies, leaked items, nulls, empty and repeated rows, and a very long text."""
    rng, home = random.Random(91), tmp_path_factory.mktemp("tables")
    texts = {i: prose(rng, rng.randint(30, 90)) for i in range(300)}
    for i in range(0, 300, 3):
        texts[i] = f"{prose(rng, 20)} vileword hateword {prose(rng, 20)}"
    items = [(i, prose(rng, 40)) for i in range(4)]
    rows = [(i, t) for i, t in texts.items()]
    rows += [(1000 + i, texts[i]) for i in (1, 2, 4, 4)]  # copies, one of them a repeated row
    rows += [(2000 + i, texts[i] + " onemoreword") for i in (5, 7)]  # near copies
    rows += [(3000 + i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, t in items]
    rows += [(4000, None), (4001, ""), (4002, " \t"), (None, prose(rng, 50)), (None, f"{items[0][1]} {prose(rng, 9)}"), (4003, prose(rng, 30_000))]
    full = [(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 4}", len(t or ""), "x", i if i is None else i % 5, None) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).coalesce(3).write.parquet(f"{home}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{home}/benchmark.parquet")
    return str(home), dict(items)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into each stage, and what comes out of it."""
    home, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder[0]).write.parquet(f"{home}/{name}")
        made = spark.read.parquet(f"{home}/{name}")
        out[name] = [tuple(r)[:8] for r in docs.collect()], [tuple(r) for r in made.collect()], docs.columns, made.columns
        docs = made
    return out


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "source_mixing"] == list(stages)
    for name, (before, after, own, made) in stages.items():
        assert made[: len(own)] == own and (made == own) == (name != "source_mixing")
        assert {r[:8] for r in after} <= set(before)


def test_toxic_documents_go(stages):
    before, after, *_ = stages["toxicity"]
    toxic = {r for r in before if "vileword" in (r[1] or "")}
    assert not toxic & set(after) and len(before) - len(after) == len(toxic)


def test_one_of_equal_texts_stays(stages):
    before, after, *_ = stages["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(normal(r[1]), []).append(r)
    want = Counter((min((x[0] is None, x[0] or 0) for x in g), t) for t, g in groups.items())
    assert Counter(((r[0] is None, r[0] or 0), normal(r[1])) for r in after) == want


def test_one_of_near_copies_stays(stages):
    before, after, *_ = stages["near_dedup"]
    sets = [(r, shingles(r[1])) for r in before]
    gone = {r for r, x in sets for o, y in sets if r[0] is not None and o[0] is not None and o[0] < r[0] and x and y and 100 * len(x & y) >= 80 * len(x | y)}
    assert gone and set(after) == set(before) - gone and len(after) == len(set(after))


def test_documents_with_items_go(stages, folder):
    before, after, *_ = stages["decontamination"]
    items = [t.split() for t in folder[1].values()]
    small = [r for r in before if len((r[1] or "").split()) < 500]
    leaked = {r for r in small for w in items if common(w, (r[1] or "").split()) >= 0.7 * len(w)}
    assert len(leaked) == 5 and set(after) == set(before) - leaked


def test_sources_are_mixed(stages, spark, folder):
    before, after, *_ = stages["source_mixing"]
    assert [r[-1] for r in after] == sorted(r[-1] for r in after) or len({r[-1] for r in after}) > 0
    n = Counter(r[3] for r in before)
    root = sum(v**0.5 for v in n.values())
    got = Counter(r[3] for r in after)
    for source, count in n.items():
        mean = count**0.5 / root * len(before)
        assert abs(got[source] - mean) < 5 * mean**0.5 + 2
    assert sorted(r[-1] for r in corpus_pipeline.run(spark, folder[0]).collect()) == sorted(r[-1] for r in after)


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
