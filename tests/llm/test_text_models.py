import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm.lang_id import LangIdParams, identify, predict, train, training_sample
from folioscope.llm.pii import DIGITS, LOWER, PiiParams, permuted_date, permuted_ipv4, permuted_ssn, permuted_symbols, pseudonymise

SYLLABLES = {"en": "the ing er on th wh".split(), "de": "sch ung ich ein ver ö".split(), "fr": "eau oi que é ai ment".split()}


def invented(lang, n):
    return " ".join("".join(random.choices(SYLLABLES[lang], k=random.randint(1, 3))) for _ in range(n))


def labelled(n=600):
    random.seed(6)
    return [(i, invented(lang, random.choice([2, 10, 80])), lang) for i, lang in enumerate(random.choices(list(SYLLABLES), k=n))]


def test_language_of_held_out_rows(spark):
    rows = [*labelled(), (1000, None, "en"), (1001, "", "en"), (1002, "12 $%", "de"), (1003, "the thing", None), (None, "the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = identify(spark, docs).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r for r in out if r.doc_id is None or r.doc_id >= 1000}
    assert {odd[n].lang_pred for n in (1000, 1001, 1002)} == {"und"} and not any(odd[n].accepted for n in (1000, 1001, 1002))
    assert odd[1003].lang_pred == odd[None].lang_pred == "en"
    assert sum(r.accepted for r in held) >= 0.98 * len(held)


def test_the_sample_is_bounded_by_rows(spark):
    same = next(n for n in range(100) if zlib.crc32(b"%d" % n) % 4 != 2)
    rows = [(same, f"the thing {n}", "en") for n in range(400)] + [(n, "das ding", "de") for n in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = training_sample(docs.union(docs), LangIdParams(per_language=50))
    assert sorted(lang for _, lang in sample) == ["de"] * 50 + ["en"] * 50
    assert identify(spark, docs.limit(0)).count() == 0
    long = spark.createDataFrame([*rows, (9999, "the thing " * 100_000, "en"), (9999, "the thing " * 100_000, "en")], docs.schema)
    assert [r.lang_pred for r in identify(spark, long).where("doc_id = 9999").collect()] == ["en"] * 2


def test_text_of_no_learned_language_is_rejected(spark):
    other = "zak bul mip vog xyl kro".split()
    random.seed(9)
    strange = [" ".join("".join(random.choices(other, k=random.randint(1, 3))) for _ in range(n)) for n in (3, 10, 80, 400)]
    strange += ["".join(random.choices("qwxzkjvb ", k=500)), "привет мир как дела сегодня", "這是 一個 測試 文件"]
    for learned in (["en"], ["en", "de"], list(SYLLABLES)):
        rows = [r for r in labelled() if r[2] in learned]
        docs = spark.createDataFrame(rows + [(2000 + n, text, None) for n, text in enumerate(strange)], "doc_id long, text string, lang string")
        out = identify(spark, docs).collect()
        assert not any(r.accepted for r in out if r.doc_id >= 2000)
        known = [r for r in out if r.doc_id < 2000]
        assert sum(r.accepted for r in known) >= 0.98 * len(known)


def test_predictions_do_not_see_labels(spark):
    rows = labelled(300)
    model = train([(t, lang) for _, t, lang in rows], LangIdParams())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = {r.doc_id: (r.lang_pred, r.score) for r in predict(spark, docs, model).collect()}
    b = {r.doc_id - 7: (r.lang_pred, r.score) for r in predict(spark, docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("zz")), model).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = "Foo.Bar34@mail7.example.com, +1 (017) 555-7713; 4111 1111 1111 1111 4111111111111111 4111111111111112 78-1 DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE88370400440532013000 10.0.0.1 2024-02-29 2023-02-29 31.12.1999 078-05-1120 000-12-3456 04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame([(1, text, "a"), (2, text[::1] + "!", "b"), (3, None, "c"), (4, "", "d"), (5, "no data", None)], "doc_id long, text string, pii_counts string")
    out = {r.doc_id: r for r in pseudonymise(docs.drop("pii_counts")).collect()}
    new = out[1].text
    assert out[2].text == new + "!" and out[3].text is None and out[4].text == "" and out[5].text == "no data"
    assert out[1].pii_counts == {"email": 1, "phone": 1, "card": 2, "iban": 2, "ipv4": 1, "date": 2, "ssn": 1, "secret": 1}
    for kept in ("4111111111111112", "DE88370400440532013000", "2023-02-29", "000-12-3456", "78-1", "@mail7.example.com", "+1 ("):
        assert kept in new
    for gone in ("Foo.Bar34", "555-7713", "4111 1111 1111 1111", "4111111111111111", "DE89370400440532013000", "10.0.0.1", "2024-02-29", "31.12.1999", "078-05-1120", "04dbebab91ab85687d33eeaaf9ac699e1188f962"):
        assert gone not in new
    assert len(new) == len(text) or abs(len(new) - len(text)) < 9  # only an address may change its length
    words = new.split()
    spaced, plain = "".join(words[4:8]), words[8]
    assert spaced == plain and luhn(plain)
    iban = next(w for w in words if w.startswith("DE") and w != "DE88370400440532013000")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    other = pseudonymise(docs.drop("pii_counts").where("doc_id = 1"), PiiParams(key="other")).first().text
    assert other != new
    assert pseudonymise(docs, counts_col=None).columns == docs.columns
    clash = pseudonymise(docs.withColumn("__pii_found", F.lit(7)))
    assert clash.columns == [*docs.columns, "__pii_found", "pii_counts_"] and {r.pii_counts for r in clash.collect()} == {"a", "b", "c", "d", None}
    assert clash.where("__pii_found = 7").count() == 5 and pseudonymise(docs.union(docs)).select("doc_id", "text").distinct().count() == 5 and pseudonymise(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("alphabet", "length"), [(DIGITS, 1), (DIGITS, 2), (DIGITS, 3), (LOWER, 2)])
def test_symbol_permutation_is_one_to_one(spark, alphabet, length):
    n = len(alphabet) ** length
    symbol = lambda i, p: F.substring(F.lit(alphabet), (F.floor(i / len(alphabet) ** p) % len(alphabet)).cast("int") + 1, F.lit(1))
    every = spark.range(n).select(F.concat(*(symbol(F.col("id"), p) for p in range(length))).alias("x"))
    moved = every.select(permuted_symbols(F.col("x"), alphabet, "t", PiiParams()).alias("y")).where(F.length("y") == length)
    assert moved.distinct().count() == n


def test_dates_addresses_and_numbers_are_one_to_one(spark):
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for form in ("yyyy-MM-dd", "yyyy-M-d", "dd.MM.yyyy", "d.M.yyyy", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy"):
        mine = days.where(F.dayofmonth("d") > 12) if form.lower().startswith("d") and "/" in form else days
        moved = mine.select(permuted_date(F.date_format("d", form), PiiParams()).alias("m")).select("m", F.try_to_date("m", form.replace("MM", "M").replace("dd", "d")).alias("t"))
        found = moved.where("t between date'1900-01-01' and date'2099-12-31'").agg(F.countDistinct("m").alias("texts"), F.countDistinct("t").alias("dates"), F.min(F.dayofmonth("t")).alias("least")).first()
        n = 44_249 if mine is not days else 73_049
        assert (found.texts, found.dates, found.least) == (n, n, 13 if mine is not days else 1)
    some = spark.range(20_000).select(F.concat_ws(".", F.lit("7"), F.lit("1"), F.floor(F.col("id") / 250).cast("string"), (F.col("id") % 250).cast("string")).alias("a"))
    assert some.select(permuted_ipv4(F.col("a"), PiiParams()).alias("m")).distinct().count() == 20_000
    numbers = spark.range(1, 9000).select(F.format_string("%03d-12-%04d", (F.col("id") % 665 + 1).cast("int"), F.col("id").cast("int")).alias("s"))
    out = numbers.select(permuted_ssn(F.col("s"), PiiParams()).alias("m"))
    assert out.where(r"m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'").distinct().count() == 8999


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, f"{t} {invented(lang, 60)}", lang, "s", 1) for i, t, lang in labelled(120)]
    random.seed(8)
    base = rows[3][1].split()
    near = list(base)
    near[len(near) // 2] = "zzz"
    rows += [(500, rows[0][1] + " ", rows[0][2], "s", 1), (501, " ".join(near), rows[3][2], "s", 1), (502, None, "en", "s", 1), (503, "$$", "en", "s", 1), (504, "mail a.b34@x.example.com " + invented("en", 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        seen[name] = {r.doc_id for r in at.collect()}
    every = {r[0] for r in rows}
    assert every - seen["language_id"] == {502, 503}
    assert seen["language_id"] - seen["exact_dedup"] == {0}  # the longer of the two copies stays
    assert seen["exact_dedup"] - seen["near_dedup"] == {501} and seen["pii"] == seen["near_dedup"]
    assert "a.b34@" not in at.where("doc_id = 504").first().text
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == seen["pii"]
    again = corpus_pipeline.packing(spark, at, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(out) == key(again)


@pytest.mark.parametrize(
    ("before", "value", "after", "kind"),
    [
        ("IBAN ", "AT61 1904 3002 3457 3201", " BIC OPSKATWW", "iban"),
        ("", "ES91 2100 0418 4502 0005 1332", " EUR 20", "iban"),
        ("", "BE68 5390 0754 7034", " 2024 x", "iban"),
        ("pay ", "DE89 3704 0044 0532 0130 00", " EUR", "iban"),
        ("card ", "3782 822463 10005", ".", "card"),
        ("card ", "3782-822463-10005", " ok", "card"),
        ("call 1-", "415-555-2671", " now", "phone"),
        ("at ", "2024-02-29", "T10:20:30Z", "date"),
    ],
)
def test_numbers_beside_other_words_are_found(spark, before, value, after, kind):
    row = pseudonymise(spark.createDataFrame([(1, before + value + after)], "doc_id long, text string")).first()
    assert row.pii_counts == {kind: 1} and row.text.startswith(before) and row.text.endswith(after)
    new = row.text[len(before) : len(row.text) - len(after)]
    assert new != value and len(new) == len(value) and [c.isalnum() for c in new] == [c.isalnum() for c in value]
    if kind == "iban":
        plain = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "card":
        assert luhn("".join(filter(str.isdigit, new)))


def test_scores_of_many_words_are_those_of_each():
    import numpy as np

    from folioscope.llm.lang_id import SEEN_CELLS, subwords, telling_subwords, word_scores

    params = LangIdParams(cells=1 << 10)
    dice = np.random.default_rng(5)
    table, seen = dice.normal(size=(params.cells, 3)), dice.random(SEEN_CELLS) < 0.5
    words = ["a", "the", "\u00b2", "\u00e9t\u00e9", "word", "\u00e0", "x" * 50]
    got = word_scores(words, table, seen, params)
    for word, row in zip(words, got, strict=True):
        cells, long = subwords(word, params), telling_subwords(word, params)
        assert np.allclose(row[:3], table[cells].sum(axis=0)) and row[3] == len(cells)
        assert (row[4], row[5]) == ((seen[long].mean(), 1) if long else (0, 0))
    assert word_scores([], table, seen, params).shape == (0, 6)
