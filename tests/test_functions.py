import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.config import IndexConfig, QueryConfig
from termloom.functions import codec
from termloom.functions.porter import stem
from termloom.functions.text import STOP_WORDS, clean, tokens, typed_key


def test_analyser(spark):
    cases = {"": [""], "?!": [""], "Don't": ["don", "t"], "café": ["caf"], "a b": ["a", "b"], "  A--b\tC\n": ["a", "b", "c"], "the of": ["the", "of"]}
    df = spark.createDataFrame([(k,) for k in cases], ["text"])
    got = {r["text"]: r for r in df.select("text", tokens(F.col("text")).alias("all"), tokens(F.col("text"), False).alias("kept"), clean(F.col("text")).alias("clean")).collect()}
    for text, want in cases.items():
        assert got[text]["all"] == want
        assert got[text]["clean"] == " ".join(want)
    assert got["the of"]["kept"] == []
    assert len(STOP_WORDS) == 153 and len(set(STOP_WORDS)) == 153


def test_porter():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor hopping hop falling fall filing file relational relat conditional condit rational ration digitizer digit triplicate triplic hopefulness hope goodness good revival reviv adjustable adjust replacement replac controll control roll roll".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word
    assert [stem(w) for w in ("sky", "skies", "dying", "ties", "enjoy", "happy", "is")] == ["sky", "sky", "die", "tie", "enjoy", "happi", "is"]


def test_codes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 4, 9, 13)], "n long")
    got = {r["n"]: (r["u"], r["g"]) for r in df.select("n", codec.unary(F.col("n")).alias("u"), codec.gamma(F.col("n")).alias("g")).collect()}
    assert {n: g for n, (_, g) in got.items()} == {1: "0", 2: "100", 4: "11000", 9: "1110001", 13: "1110101"}
    assert got[4][0] == "1110" and got[9][0] == "111111110"
    assert codec.pack_values(np.array([3, 1, 2, 4, 2]), np.array([5]), "unary") == [bytes.fromhex("CBAF")]
    assert codec.unpack_values([bytes.fromhex("CBAF")], "unary")[0].tolist() == [3, 1, 2, 4, 2]
    for make in (codec.pack_udf, codec.decode_udf, codec.encode_blocks, codec.decode_blocks):
        with pytest.raises(ValueError):
            make("zip")


@pytest.mark.parametrize("name", ["unary", "gamma"])
def test_lists_survive_their_codes(spark, name):
    lists = [([0], [1]), ([0, 1, 5, 90], [3, 1, 2, 7]), ([7, 8, 300], [1, 1, 1])]
    df = spark.createDataFrame(lists, "d array<long>, f array<int>")
    coded = codec.encode_blocks(name)(F.col("d"), F.col("f"), F.lit(0))
    out = df.withColumn("back", codec.decode_blocks(name)(coded, F.lit(0))).withColumn("sum", codec.from_gaps_udf()(codec.gaps(F.col("d"))))
    for r in out.collect():
        assert r["back"]["docids"] == r["d"] == r["sum"] and r["back"]["freqs"] == r["f"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=30))
def test_decoding_inverts_coding(values):
    for name in ("unary", "gamma"):
        code = (lambda n: "1" * (n - 1) + "0") if name == "unary" else (lambda n: "1" * (n.bit_length() - 1) + "0" + f"{n:b}"[1:])
        bits = "".join(map(code, values))
        bits += "1" * (-len(bits) % 8)
        data = int(bits, 2).to_bytes(len(bits) // 8, "big")
        assert codec.unpack_values([b"", data, data], name)[0].tolist() == values * 2
        assert codec.pack_values(np.array(values), np.array([len(values)]), name) == [data]


def test_typed_keys(spark):
    df = spark.createDataFrame([("",), (" 12",), ("x1",), (None,)], "v string")
    assert [r[0] for r in df.select(typed_key(F.col("v"))).collect()] == [0, 12, None, None]
    assert [r[0] for r in df.select(typed_key(F.col("v"), "string")).collect()] == ["", " 12", "x1", None]


def test_options_are_checked():
    for bad in (lambda: IndexConfig(codec="zip"), lambda: QueryConfig("both"), lambda: QueryConfig(scoring="LM"), lambda: QueryConfig(k=0), lambda: QueryConfig(search="linear")):
        with pytest.raises(ValueError):
            bad()
    assert QueryConfig().run_name("x") == "x BM25 10 disjunctive ternary"
