"""Nearest-time matching, packing, mixing and personal information against brute force and hand-made cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import parity
from terrawing.llm import mixing, packing, pii, tokens
from terrawing.llm import queries as Q
from terrawing.llm.nearest import nearest

FOLDER = str(parity.DATA / "sf0.001")


# ------------------------------------------------------------------ nearest


@pytest.mark.parametrize("rows_per_block", [30, 200_000])
def test_nearest_against_brute_force(spark, rows_per_block):
    rng = random.Random(5)
    right = [(k, i, round(rng.uniform(0, 60), 2)) for k in (1, 2) for i in range(150 if k == 1 else 20)]
    left = [(k, i, round(rng.uniform(-2, 62), 2)) for k in (1, 2, 3) for i in range(120)]
    right += [right[0], (1, 900, None), (None, 1, 5.0)]
    rows = left + [left[0], left[0], (1, 901, None), (1, 902, float("nan")), (None, 3, 1.0)]
    a = spark.createDataFrame([(*r, "x", 0) for r in rows], "e long, f long, t double, side string, id int")
    b = spark.createDataFrame([(*r, "y", 0) for r in right], "e long, s long, u double, side string, id int")
    got = [tuple(r)[:3] for r in nearest(a, b, "e", "t", "u", "f", "s", 0.5, rows_per_block).collect()]
    want = []
    for k, f, t in left:
        near = sorted((round(abs(u - t), 6), u, s) for kk, s, u in right if kk == k and u is not None and round(abs(u - t), 6) <= 0.5)
        want.append((k, f, near[0][2] if near else None))
    assert Counter(got) == Counter(want)


def test_nearest_of_empty_tables_and_over_many_batches(spark):
    none = spark.createDataFrame([], "e long, f long, t double")
    some = spark.range(30_000).select(F.lit(1).cast("long").alias("e"), F.col("id").alias("f"), (F.col("id") * 0.1).alias("t"))
    assert nearest(none, some, "e", "t", "t", "f", "f", 1.0).count() == 0
    assert nearest(some, none, "e", "t", "t", "f", "f", 1.0).where("nearest_id is not null").count() == 0
    shifted = some.withColumn("t", F.col("t") + 0.03)
    got = nearest(shifted, some, "e", "t", "t", "f", "f", 1.0).where("nearest_id = f")
    assert got.count() == 30_000


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = parity.differences(spark, Q.QUERIES[name], Q.SQL[name], FOLDER)
    assert not ours and not theirs


# ------------------------------------------------------------------ packing


def pack_rows(spark, sizes, containers, buckets):
    df = spark.createDataFrame(list(enumerate(sizes)), "item_id long, size long")
    return packing.pack(df, "item_id", "size", containers, buckets).collect()


def test_packing_keeps_every_token_and_no_container_overflows(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 7, 100, 512, 513, 1024, 5000, None]) if rng.random() < 0.3 else rng.randint(1, 600) for _ in range(900)]
    rows = pack_rows(spark, sizes, {"short": 512, "long": 2048}, 3)
    for kind, capacity in (("short", 512), ("long", 2048)):
        mine = [r for r in rows if r["container_kind"] == kind]
        load, pieces = Counter(), defaultdict(list)
        for r in mine:
            load[r["container_id"]] += r["size"]
            pieces[r["item_id"]].append((r["piece"], r["start"], r["size"]))
        assert max(load.values()) <= capacity and set(pieces) == set(range(len(sizes)))
        for i, n in enumerate(sizes):
            parts = sorted(pieces[i])
            assert sum(p[2] for p in parts) == (n or 0) and [p[1] for p in parts] == [k * capacity for k in range(len(parts))]
            assert len(parts) == 1 or n > capacity
        assert sum(n or 0 for n in sizes) / (len(load) * capacity) > 0.93


def test_sum_of_squares_chooses_what_it_says():
    rng = random.Random(4)
    capacity = 24
    p = packing.Packer(capacity)
    for _ in range(400):
        size = rng.randint(1, capacity - 1)
        before = p.counts.copy()

        def cost(gap):
            n = before.copy()
            if gap < capacity:
                n[gap] -= 1
            if gap - size:
                n[gap - size] += 1
            return int((n**2).sum())

        best = min([cost(capacity)] + [cost(g) for g in range(size, capacity) if before[g]])
        p.place(size)
        assert int((p.counts**2).sum()) == best


def test_packing_nothing(spark):
    assert pack_rows(spark, [], {"short": 512}, 1) == [] and pack_rows(spark, [3], {}, 1) == []
    with pytest.raises(ValueError):
        pack_rows(spark, [3], {"none": 0}, 1)


def test_packing_fills_the_containers_of_the_corpus(spark):
    rows = {r["container_kind"]: r for r in Q.p7_fill(spark, str(parity.DATA / "sf0.01")).collect()}
    assert rows["short"]["filled"] > 0.97 and rows["long"]["filled"] > 0.97


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a b " * 20_000)], "id long, text string")
    got = {r["id"]: r["n_tokens"] for r in tokens.with_tokens(df, "text", ["id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 40_000


# ------------------------------------------------------------------- mixing


def docs(spark, n=4000):
    rng = random.Random(6)
    rows = [(i, rng.choices(["a", "b", "c", None, "other"], [60, 25, 5, 5, 5])[0], int(rng.paretovariate(1.2) * 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_shares_caps_and_repeats(spark):
    rows, df = docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.28, 2), ("c", 0.2, 4), ("gone", 0.02, 3)], "source_name string, target_share double, max_repeats int")
    plan = mixing.rates(df, "doc_id", "source", "n_tokens", targets, 11)
    got = mixing.draw(df, "doc_id", "source", "n_tokens", plan, 11).collect()
    assert [r["place"] for r in got] == sorted(r["place"] for r in got)
    most = {"a": 1, "b": 2, "c": 4}
    copies = Counter(r["item_id"] for r in got)
    source = {i: s for i, s, _ in rows}
    assert all(c <= most[source[i]] for i, c in copies.items()) and {source[i] for i in copies} == set(most)
    tokens_of = Counter()
    for r in got:
        tokens_of[r["source"]] += r["n_tokens"]
    assert {p.source: p.drawn for p in plan if p.drawn} == dict(tokens_of)
    total = sum(tokens_of.values())
    for s, share in (("a", 0.5), ("b", 0.28), ("c", 0.2)):
        assert tokens_of[s] / total == pytest.approx(share / 0.98, abs=0.004)
    report = {r["source_name"]: r for r in mixing.shares(mixing.draw(df, "doc_id", "source", "n_tokens", plan, 11), targets).collect()}
    assert report["gone"]["n_copies"] == 0 and report["c"]["most_copies"] <= 4
    again = mixing.draw(df.repartition(7), "doc_id", "source", "n_tokens", mixing.rates(df, "doc_id", "source", "n_tokens", targets, 11), 11).collect()
    assert again == got


def test_many_sources_go_in_batches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BATCH", 2)
    rows = [(i, f"s{i % 7}", 10 + i % 5) for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(f"s{k}", 1 / 7, 1 + k % 2) for k in range(7)], "source_name string, target_share double, max_repeats int")
    plan = mixing.rates(df, "doc_id", "source", "n_tokens", targets, 3)
    got = Counter()
    for r in mixing.draw(df, "doc_id", "source", "n_tokens", plan, 3).collect():
        got[r["source"]] += r["n_tokens"]
    assert dict(got) == {p.source: p.drawn for p in plan} and len(got) == 7 and max(got.values()) / min(got.values()) < 1.02


def test_mixing_nothing(spark):
    _, df = docs(spark, 50)
    none = spark.createDataFrame([], "source_name string, target_share double, max_repeats int")
    assert mixing.draw(df, "doc_id", "source", "n_tokens", mixing.rates(df, "doc_id", "source", "n_tokens", none, 1), 1).count() == 0
    one = spark.createDataFrame([("zzz", 1.0, 2), ("a", None, 2)], "source_name string, target_share double, max_repeats int")
    assert mixing.draw(df, "doc_id", "source", "n_tokens", mixing.rates(df.limit(0), "doc_id", "source", "n_tokens", one, 1), 1).count() == 0


def test_thresholds_are_those_of_a_poisson_distribution():
    cuts = mixing.thresholds(1.3, 6)
    sample = np.random.default_rng(0).random(200_000)
    counts = (sample[:, None] > np.array(cuts)).sum(1)
    assert counts.mean() == pytest.approx(1.3, abs=0.02) and counts.var() == pytest.approx(1.3, abs=0.03)
    assert mixing.thresholds(float("inf"), 3) == (0.0, 0.0, 0.0) and mixing.thresholds(0, 3) == ()


# --------------------------------------------------------------------- pii


def items(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Maintainer: Ingrid Solberg <ingrid.solberg+git@mail.example>, tel +44 (0)7700 900448", [("name", "Ingrid Solberg"), ("email", "ingrid.solberg+git@mail.example"), ("phone", "+44 (0)7700 900448")]),
        ("// Written by Q. Tarasque (q.tarasque AT firm DOT co DOT example)", [("name", "Q. Tarasque"), ("email", "q.tarasque AT firm DOT co DOT example")]),
        ("# Owner: lena [dot] voss [at] firm [dot] example", [("email", "lena [dot] voss [at] firm [dot] example")]),
        ("see mail=bob%40firm.example&x=1", [("email", "bob%40firm.example")]),
        ("bob(at)firm.example", [("email", "bob(at)firm.example")]),
        ("clone with git@forge.example:team/repo.git, https://ci:tok@host.example/x, $USER@host.example, icon@2x.png, voxel@7.4.7", []),
        ("* van der Berg, Maria <maria@firm.example>", [("name", "van der Berg, Maria"), ("email", "maria@firm.example")]),
        ("// (C) LENA O'BRIEN 2017", [("name", "LENA O'BRIEN")]),
        ("// Copyright 2017 Acme Robotics Ltd, uses the Delaunay Mesher at Lake Ombra", []),
        ("# Copyright 2020-2021 Paula al-Rashid. All rights reserved.", [("name", "Paula al-Rashid")]),
        ("// maintained since 2014 by Dr. Anna-Lena Voss", [("name", "Anna-Lena Voss")]),
        ("licence on file under SSN 971-07-2734, dni 00038343-O, NINO QQ 56 83 76 C, passport no. X0068435, aadhaar_no 0311 5353 6391", [("id_number", x) for x in ("971-07-2734", "00038343-O", "QQ 56 83 76 C", "X0068435", "0311 5353 6391")]),
        ("// serial 4602 7617 1249, part no. 697-90-391, crc32 709-7636, epoch 1703873852 to 1725165712", []),
        ('crew = "Marta Keller;000 32 5481;02079460018";', [("name", "Marta Keller"), ("id_number", "000 32 5481")]),
        ("Flat 51, 411 Kestren St, Ombrac ZZ1 5ZZ", [("address", "Flat 51, 411 Kestren St")]),
        ("home: Bornweg 78, 00697 Pellingen | 44 bis rue des Tilleuls, 00050 Norvale | 560 Tessaly Court", [("address", "Bornweg 78"), ("address", "44 bis rue des Tilleuls"), ("address", "560 Tessaly Court")]),
        ("// see room 9, Copper Ridge site, block 9", []),
        ("// tel:+49 30 23125 155 or fax 212-555-0104, 030/23125-067, (415) 555-0151, 01.99.00.85.58, 0491-570-159, 020 7946 0041", [("phone", x) for x in ("+49 30 23125 155", "212-555-0104", "030/23125-067", "(415) 555-0151", "01.99.00.85.58", "0491-570-159", "020 7946 0041")]),
        ("call four one five, five five five, zero one five one", [("phone", "four one five, five five five, zero one five one")]),
        ("or zero two zero seven nine four six zero nine five eight!", [("phone", "zero two zero seven nine four six zero nine five eight")]),
        ("tel. 415-five five five 0151", [("phone", "415-five five five 0151")]),
        ("plus four nine three oh two three double one two five", [("phone", "plus four nine three oh two three double one two five")]),
        ("serial number one two three four five six seven eight, steps one, two, three", []),
        ("ssn: nine seven one two seven two seven three four", [("id_number", "nine seven one two seven two seven three four")]),
        ("jane [ at ] example.com, jane.doe At example Dot com, jo&#x40;ex.org, jo&#0064;ex&#46;org, &#106;o@ex.org, jo%40ex%2Eorg", [("email", x) for x in ("jane [ at ] example.com", "jane.doe At example Dot com", "jo&#x40;ex.org", "jo&#0064;ex&#46;org", "&#106;o@ex.org", "jo%40ex%2Eorg")]),
        ("\U0001d423\U0001d428@ex.org, jо@ех.org, \uff4ao@ex.org", [("email", x) for x in ("\U0001d423\U0001d428@ex.org", "jо@ех.org", "\uff4ao@ex.org")]),
        ("Reviewed by: Thandiwe Mbeki\nThanks Wei Zhang for the data\npatch by Siobhan Okonkwo\n(c) 2019 Thandeka Nkosi\n", [("name", x) for x in ("Thandiwe Mbeki", "Wei Zhang", "Siobhan Okonkwo", "Thandeka Nkosi")]),
        ("# Authors: Thandiwe Mbeki, Wei Zhang and Siobhan Okonkwo\n# uses the Gauss Newton step", [("name", x) for x in ("Thandiwe Mbeki", "Wei Zhang", "Siobhan Okonkwo")]),
        ("x = 'Thandiwe Mbeki;thandiwe.mbeki@firm.example;212-555-0104'\ny = 'Delaunay Mesher'", [("name", "Thandiwe Mbeki"), ("email", "thandiwe.mbeki@firm.example"), ("phone", "212-555-0104")]),
        ("Contributors\n* Thandiwe Mbeki <tm@firm.example>\n* W. Zhang\n* Okonkwo, Siobhan\n\nThe Delaunay Mesher", [("name", "Thandiwe Mbeki"), ("email", "tm@firm.example"), ("name", "W. Zhang"), ("name", "Okonkwo, Siobhan")]),
        ("// TODO: ask Thandiwe Mbeki about the shift, as agreed with Wei Zhang (212-555-0104); ask Copper Ridge for maps", [("name", "Thandiwe Mbeki"), ("name", "Wei Zhang"), ("phone", "212-555-0104")]),
        ("crew:\n  - name: \"Thandiwe Mbeki\"\n    tel: \"+13035550168\"\nsite:\n  - id: 1\n    size: 3\n    name: \"Delaunay Mesher\"\n", [("name", "Thandiwe Mbeki"), ("phone", "+13035550168")]),
        ("// @author Mbeki, Thandiwe\n# Copyright 2019-2020 Zhang, Wei. All rights reserved.", [("name", "Mbeki, Thandiwe"), ("name", "Zhang, Wei")]),
        ("123 5th Ave, then 40 W 23rd Street", [("address", "123 5th Ave"), ("address", "40 W 23rd Street")]),
        ("id number 123456789", [("id_number", "123456789")]),
        ("pilot: Lena Voss;" + "x" * 3000 + ";971-07-2734;", [("name", "Lena Voss"), ("id_number", "971-07-2734")]),
        ("a" * 90 + "@firm.example", [("email", "a" * 90 + "@firm.example")]),
        ("https://user:" + "p" * 200 + "@firm.example/x", []),
        ("serial no." + " " * 80 + "4602 7617 1249 and build" + "." * 70 + "415-555-0104", []),
        ("VALUES ('Tara Winter', 'b')", [("name", "Tara Winter")]),
        ("", []),
        (None, []),
    ],
)
def test_items(text, want):
    assert items(text) == want


def test_positions_come_back_from_the_normalised_text():
    text = "x ＠ " + "# Owner: ​jane​ [at] firm [dot] example, tel +1 (212) 555-0112; аnna@firm.example"
    got = pii.find(text)
    assert [k for k, _, _ in got] == ["email", "phone", "email"]
    assert text[got[0][1] : got[0][2]].replace("​", "") == "jane [at] firm [dot] example" and text[got[1][1] : got[1][2]] == "+1 (212) 555-0112" and text[got[2][1] : got[2][2]] == "аnna@firm.example"
    normal = pii.normalise(text)
    assert all(0 <= normal.back(i) <= len(text) for i in range(len(normal.text)))


def test_placeholders_keep_the_rest():
    text = "a\r\n# Maintainer: Lena Voss <lena@firm.example>\r\nb"
    assert pii.replace(text) == ("a\r\n# Maintainer: <NAME> <<EMAIL>>\r\nb", 2)
    assert pii.replace("nothing") == ("nothing", 0) and pii.replace(None) == (None, 0)


def test_long_and_odd_texts_end():
    for text in ("a" * 300_000, "A B " * 50_000, "1 " * 100_000, "@" * 20_000, "a." * 50_000 + "@", "Aa-" * 50_000, "(0" * 50_000, "\x00\ud800", "00 " * 60_000):
        pii.find(text)


def test_found_items_in_spark(spark):
    df = spark.createDataFrame([(1, "mail lena@firm.example", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, pii_type string")
    assert [tuple(r) for r in pii.found_items(df, "doc_id", "text").collect()] == [(1, "email", 5, 22)]
    assert [tuple(r) for r in pii.redacted(df, "doc_id", "text").orderBy("doc_id").collect()] == [(1, "mail <EMAIL>", 1), (2, None, 0), (3, "", 0)]
