import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import venues

LIST = [(1, "Journal of Neural Cartography", "JNC"), (2, "Transactions on Neural Cartography", None), (3, "Halden Symposium on Memory and Attention", "HSMA"), (4, "arXiv", "arXiv"), (5, "Neural Cartography Letters", "LNC")]


def mapped(spark, values, entries=LIST):
    v = spark.createDataFrame([(x,) for x in values], "value string")
    e = spark.createDataFrame(entries, "key int, name string, alias string")
    return {r["value"]: r["key"] for r in venues.map_values(v, e).collect()}


def test_forms_of_a_venue(spark):
    want = {
        "Journal of Neural Cartography": 1, "  JOURNAL  OF NEURAL CARTOGRAPHY.": 1, "J. of Neur. Carto.": 1, "Journal of Nueral Cartograhy, vol. 3": 1, "{JNC}": 1, "jnc": 1, "JNC'25": 1, "Neural Cartography, Journal of": 1,
        "Trans. Neural Cartography 3(2)": 2, "Neural Cartography Lett.": 5, "Proceedings of the 2021 Halden Symposium on Memory \\& Attention, Lindmouth": 3, "HSMA-24": 3, "InHSMA": 3, "Halden Symposium on Memory and At": 3, "Proceedings of the Halden Symposium on Memory and Attention Lindmouth": 3, "Halden Symposium on Memory and Attention Lindmouth": 0, "Halden Symp. Mem. Atten. (Halden Press)": 3,
        "arXiv preprint arXiv:2101.00001": 4, "ArXiv, abs/2101.00001": 4, "Journal of Polar Numismatics": 0, "Annals of Neural Cartography": 0, "Journal of Neural Sedimentology": 0, "Technical report TR-1": 0, "2021": 0, "HSMB": 0, "x" * 20_000: 0,
    }
    assert mapped(spark, list(want)) == want


def test_words_of_place_and_publisher_do_not_hide_a_name(spark):
    entries = [(7, "International Conference on Plasma Simulation", None)]
    want = {"Proc. Int. Conf. Pals. Simu., Ostrava Bay": 7, "Int. Conf. Pals. Simu., Ostrava Bay, Halden University Press, Lecture Records Collection": 7, "Ostrava Bay, Halden University Press": 0}
    assert mapped(spark, list(want), entries) == want


def test_values_in_one_word(spark):
    want = {
        '"ARXIVpreprint"': 4, "arXivpreprint arXiv:2101.00001": 4, "arXvi": 4, "arXv": 4, "JournalofNeuralCartography": 1, "HaldenSymposiumOnMemoryAndAttention": 3, "NeuralCartograhyLetters": 5,
        "ar": 0, "bioRxiv": 0, "Archiv": 0, "HSMB": 0, "JNB": 0, "Journal": 0,
    }
    assert mapped(spark, list(want)) == want


def test_nothing_to_map(spark):
    assert mapped(spark, []) == {} and mapped(spark, ["JNC"], LIST[:0] or [(9, None, None)]) == {"JNC": 0}


def test_rows_keep_their_keys_and_a_hot_value(spark):
    rows = [(i, "JNC") for i in range(900)] + [(i, f"odd {i}") for i in range(900, 1000)] + [(1001, None), (1002, "  ")]
    df = spark.createDataFrame(rows, "id int, v string")
    out = venues.resolve(df, "v", "id", spark.createDataFrame(LIST, "key int, name string, alias string"))
    got = {r["id"]: r["key"] for r in out.collect()}
    assert len(got) == 1000 and sum(k == 1 for k in got.values()) == 900


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), min_size=1), min_size=1, max_size=8), st.lists(st.sets(st.sampled_from("abcdefgh"), min_size=1), min_size=1, max_size=8))
def test_join_equals_brute_force(spark, left, right):
    l = spark.createDataFrame([(f"l{i}", sorted(s)) for i, s in enumerate(left)], "l string, els array<string>")
    r = spark.createDataFrame([(f"r{i}", sorted(s)) for i, s in enumerate(right)], "r string, els array<string>")
    for t in (0.25, 0.6):
        want = {(f"l{i}", f"r{j}"): len(a & b) / len(a | b) for i, a in enumerate(left) for j, b in enumerate(right) if len(a & b) / len(a | b) >= t}
        got = {(x["l"], x["r"]): x["jaccard"] for x in venues.similar(l, r, t).collect()}
        assert got == pytest.approx(want)
