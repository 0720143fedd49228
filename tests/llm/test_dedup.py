import random
from collections import Counter

import pytest

from folioscope.llm.components import components
from folioscope.llm.common import Scratch
from folioscope.llm.order_minhash import OrderMinHashParams, alike, banded_distance, near_classes, rare_runs, words_of
from folioscope.llm.substring_dedup import FingerprintLog, SubstringParams, substring_dedup


def kept_by_brute_force(rows):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x.decode() for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


def repeats(n):
    random.seed(n)
    passage = " ".join(random.choice("abcdefgh") for _ in range(70))
    rows = []
    for d in range(n):
        text = " ".join(random.choice(["aa", "b", "cé"]) for _ in range(random.choice([0, 5, 60, 130])))
        if d % 3 == 0:
            text += " " + passage[: random.randint(80, 139)] + "\n"
        if d % 5 == 0:
            text = "x " * random.randint(40, 90) + text
        rows.append((d, text))
    return [*rows, (n, None), (n + 1, "")]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substrings_match_brute_force(spark, batches):
    rows = repeats(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup(spark, docs, batches, SubstringParams(max_runs=2), with_text=True)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == kept_by_brute_force(rows)


def test_runs_are_compacted(spark):
    log = FingerprintLog(spark, SubstringParams(max_runs=1))
    docs = spark.createDataFrame(repeats(20), "doc_id long, text string")
    log.ingest(docs.where("doc_id < 10")).count()
    log.ingest(docs.where("doc_id >= 10"), docs.where("doc_id < 10")).count()
    assert len(log.runs) == 1


def test_a_log_is_reopened(spark, tmp_path):
    rows = repeats(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/log"
    first = FingerprintLog(spark, path=path).ingest(docs.where("doc_id < 10"), with_text=True).collect()
    again = FingerprintLog(spark, path=path)
    assert len(again.runs) == 1
    out = first + again.ingest(docs.where("doc_id >= 10"), docs.where("doc_id < 10"), with_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == kept_by_brute_force(rows)


def test_substrings_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, passage), (1, passage), (1, passage), (None, passage), (None, None), (3, passage + " end"), (4, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as fp", "2 as row_id", "3 as low", "4 as places", "true as in_batch")
    out = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(spark, docs).collect()))
    assert out == [(0, 0, 0), (0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 60, 60), (3, 61, 60), (4, 200_000, 0)]
    assert substring_dedup(spark, docs.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    random.seed(3)
    for _ in range(3000):
        a, b = ([random.randrange(3) for _ in range(random.randint(0, 12))] for _ in range(2))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        limit, true = random.randint(0, 7), edit_distance(a, b)
        assert banded_distance(a, b, limit) == (true if true <= limit else limit + 1)


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, n) for n in range(401, 460)]
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    want = {x: of(x) for x in list(root) if any(x in link and link[0] != link[1] for link in links)}
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    rows = [(r.id, r.component) for r in got.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == want


def test_near_copies_and_clean_documents(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghijk", k=5))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(random.choice([60, 120, 300]))]
        for n in range(random.choice([1, 2, 25])):
            text = list(base)
            for _ in range(len(base) // 30 if n else 0):
                text[random.randrange(len(text))] = word()
            doc = len(rows)
            group[doc] = g
            rows.append((doc, " ".join(text).title() if n % 2 else " ".join(text)))
    shared = " ".join(word() for _ in range(60))
    for _ in range(30):  # a passage in common is not a near copy
        group[len(rows)] = f"clean{len(rows)}"
        rows.append((len(rows), " ".join(word() for _ in range(100)) + " " + shared))
    odd = [(900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "?!"), (905, "one two three")]
    group |= {900: "e", 901: "n", 902: "s", 903: "s", 904: "w", 905: "t"}
    docs = spark.createDataFrame([*rows, *odd, rows[0]], "doc_id long, text string")
    out = near_classes(spark, docs, OrderMinHashParams(tile=4)).collect()
    classes = {r.doc_id: r.class_id for r in out}
    least = {}
    for doc, g in group.items():
        least[g] = min(doc, least.get(g, doc))
    assert classes == {doc: least[g] for doc, g in group.items()}
    assert all(r.kept == (r.class_id == r.doc_id) for r in out)
    sizes = Counter(classes.values())
    assert all(r.class_size == sizes[r.class_id] for r in out)
    assert near_classes(spark, docs.limit(0)).count() == 0


def test_alike_is_the_edit_share():
    a = words_of("one two three four five six seven eight nine ten")
    assert alike(a, a[:8], 0.8) and not alike(a, a[:7], 0.8) and alike(a, ["x", *a[1:9], "y"], 0.8)


def test_links_down_to_the_threshold_are_found(spark):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    rows, pairs = [], []

    def copy_of(base, at):
        changed = [word() if i in at else w for i, w in enumerate(base)]
        pairs.append((len(rows), len(rows) + 1))
        rows.extend([(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed))])

    for share in (0.05, 0.1, 0.15, 0.2):  # scattered and evenly spaced edits
        for n in (20, 60, 300):
            edits = int(share * n)
            for _ in range(6):
                copy_of([word() for _ in range(n)], set(random.sample(range(n), edits)))
                copy_of([word() for _ in range(n)], {i * n // edits + 2 for i in range(edits)})
    low = len(pairs)
    for n in range(5, 15):  # short texts, every single edit and pairs of edits
        for i in range(n):
            copy_of([word() for _ in range(n)], {i})
            if n >= 10:
                copy_of([word() for _ in range(n)], {i, (i + n // 2) % n})
    rows += [(5000, "red green blue white"), (5001, "red green grey blue white"), (5002, "one two three four"), (5003, "one two three five")]
    pairs += [(5000, 5001)]
    words = {d: t.split() for d, t in rows}
    assert all(alike(words[a], words[b], 0.8) for a, b in pairs)
    classes = {r.doc_id: r.class_id for r in near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [classes[a] == classes[b] == a for a, b in pairs]
    assert sum(found[:low]) >= 0.97 * low and all(found[low:])
    assert classes[5003] == 5003 and len(set(classes.values())) >= len(rows) - len(pairs)


def links_by_brute_force(rows):
    """All linked pairs of different texts, every pair aligned."""
    words = [(d, words_of(t)) for d, t in rows]
    return [(a, b) for n, (a, x) in enumerate(words) for b, y in words[:n] if x and y and x != y and alike(x, y, 0.8)]


def test_links_of_a_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    for d, t in rows[:100]:  # 5 to 20 % of the words changed
        words = (t or "").split()
        for share in (0.05, 0.12, 0.2):
            at = set(random.sample(range(len(words)), int(share * len(words))))
            rows.append((10_000 + len(rows), " ".join(word() if i in at else w for i, w in enumerate(words))))
    links = links_by_brute_force(rows)
    assert len(links) > 300
    classes = {r.doc_id: r.class_id for r in near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(classes[a] == classes[b] for a, b in links) >= 0.99 * len(links)
    root = {d: d for d, _ in rows}
    for a, b in [*links, *((a, b) for n, (a, x) in enumerate(rows) for b, y in rows[:n] if words_of(x) and words_of(x) == words_of(y))]:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    for d, c in classes.items():  # no class goes beyond the links
        x = d
        while root[x] != x:
            x = root[x]
        assert c >= x


def test_a_hot_passage_makes_no_pairs_and_hides_no_links(spark):
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(200))
    rows = [(d, " ".join(word() for _ in range(150)) + " " + passage) for d in range(300)]
    want = {d: d for d, _ in rows}
    for d in range(0, 300, 30):  # near copies of some, over the group's common passage
        words = rows[d][1].split()
        for i in random.sample(range(len(words)), 40):
            words[i] = word()
        rows.append((1000 + d, " ".join(words)))
        want[1000 + d] = d
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (16, 512):
        assert {r.doc_id: r.class_id for r in near_classes(spark, docs, OrderMinHashParams(tile=tile)).collect()} == want


def test_buckets_of_what_is_not_shared(spark):
    random.seed(13)
    word = lambda: random.choice("abcdefghijklmnop")
    rows = []
    for n in (3, 5, 8, 15, 40):
        for _ in range(20):
            base = [word() for _ in range(n)]
            for edits in (0, n // 10, n // 5):
                text = list(base)
                for _ in range(edits):
                    text[random.randrange(len(text))] = word()
                rows.append((len(rows), " ".join(text)))
    found = {}
    for r in rare_runs(spark.createDataFrame(rows, "doc_id long, text string"), OrderMinHashParams()).collect():
        found.setdefault(r.sketch, set()).add(r.doc_id)
    met = {(a, b) for ids in found.values() for a in ids for b in ids}
    assert all(link in met for link in links_by_brute_force(rows))


def test_near_classes_of_odd_tables(spark):
    long = "word " * 30_000
    rows = [(None, "one two three", 1, "x"), (None, "one two three", 1, "x"), (1, long, 2, None), (2, long + "more", 3, "y"), (3, None, None, None), (2, "else", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long, band string")
    out = sorted(((r.doc_id or -1, r.class_id or -1, r.kept) for r in near_classes(spark, docs).collect()))
    assert out == [(-1, -1, True), (-1, -1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]


def test_functions_of_near_dedup_load_without_the_package(tmp_path):
    """Workers may lack the package: what is sent to them must hold it by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    import folioscope
    from folioscope.llm import order_minhash as M

    cloudpickle.register_pickle_by_value(folioscope)
    (tmp_path / "sent").write_bytes(cloudpickle.dumps([M.sketches_of, M.hash_family, M.text_sketches]))
    code = "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p]; f = pickle.load(open('sent', 'rb')); assert f[1](3, 1)[0].shape == (3,); assert 'folioscope' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, check=True)
