"""Many rules: literals of patterns, the index, and hits against one by one."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textsluice.functions import detect
from textsluice.functions.dialect import to_java
from textsluice.functions.literals import required
from textsluice.functions.rules import INPUT_RULES, OUTPUT_PII_RULES, POLICIES, Rule, SECRET_RULES
from textsluice.operators.policies import policy_hits, policy_table
from textsluice.operators.rule_index import candidates, grams, pattern_hits, rule_index


@pytest.mark.parametrize("pattern,literals", [
    (r"(?i)TOPsecret\b", {"topsecret"}), ("", None), (r"\d{4}", None), ("a|bc|def", {"a", "bc", "def"}), ("abc|", None), ("(abc)?def", {"def"}),
    ("(foo|ba[rz])+qux?", {"qu"}), ("x{0,2}yes{2}", {"yes"}), (r"a\.b\/c", {"a.b/c"}), ("ab*cde", {"cde"}), ("[]a]bcd", {"bcd"}), (r"\x41bcd", {"bcd"}),
    (r"\x{41}bcd", {"bcd"}), (r"Abcd", {"abcd"}), (r"\u0041bcd", {"bcd"}), ("é1234", {"1234"}), ("(unclosed", None), ("(?i:HELLO)|ok then", {"hello", "ok then"}),
    ("[[:alpha:]x]yz+w", {"yz"}), (r"\p{Lu}abc", {"abc"}), ("(?i)(one|three)four", {"four"}), ("(?i)(seven|three)four", {"seven", "three"}), ("(?P<n>hello) world", {" world"})])
def test_literals(pattern, literals):
    assert required(pattern) == (literals and frozenset(literals))


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.text("abc.", min_size=1, max_size=4).map(lambda t: t.replace(".", r"\.")), lambda inner: st.one_of(
    st.lists(inner, min_size=2, max_size=3).map("|".join).map("({})".format), st.lists(inner, min_size=1, max_size=3).map("".join),
    inner.map("({})?".format), inner.map("({})+".format), inner.map("({}){{2}}".format), inner.map("{}[bc]*".format))), st.text("abc.", max_size=30))
def test_every_match_holds_a_literal(pattern, text):
    import re

    literals = required(pattern)
    for found in re.finditer(pattern, text):
        assert literals is None or any(x in found[0] for x in literals)


def test_fixed_rules_have_literals():
    rules = (*INPUT_RULES, *SECRET_RULES, *OUTPUT_PII_RULES, *POLICIES)
    assert sum(required(r.pattern) is not None for r in rules) >= len(rules) - 6
    assert grams("ab") == [-1] and len(grams("(?i)union select|drop")) == 2 and grams("abcdefg")[0] > 1 << 50


def test_ten_thousand_rules(spark):
    r = random.Random(8)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 9))) for _ in range(10_000)]
    patterns = [rf"(?i){n}\s+\w+" if i % 3 else rf"{n}|{n[::-1]}z" for i, n in enumerate(names)]
    rules = spark.createDataFrame([(i, f"r{i}", p, "warn", "") for i, p in enumerate([*patterns, "(", "", "K+elvin"])],
                                  "ord long, name string, pattern string, action string, description string")
    texts = [" ".join(r.choice(names).upper() if r.random() < 0.3 else "plain words here" for _ in range(20)) for _ in range(60)]
    texts += [None, "", "Kelvin kKelvin", names[0] + "é", texts[0], names[3] * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(x.id, x.pattern) for x in pattern_hits(df, rules, "id").collect()}
    import re

    compiled = [(p, re.compile(p)) for p in [*patterns, ""]]
    want = {(i, p) for i, t in enumerate(texts) if t is not None for p, c in compiled if c.search(t)} | {(62, "K+elvin")}
    assert got == want and len(want) > 250
    pairs = candidates(df, rule_index(rules)).count()
    assert pairs < 6 * len(got)          # of some 660,000


def test_repeated_rows_and_null_texts(spark):
    df = spark.createDataFrame([(1, "jail"), (1, "jail"), (None, "jail"), (2, None)], "id long, text string")
    found = pattern_hits(df, policy_table(spark).limit(0).union(spark.createDataFrame([(0, "n", "jail", "warn", "")], "a long, b string, c string, d string, e string")), "id")
    assert sorted(str(x.id) for x in found.collect()) == ["1", "1", "None"]
    assert pattern_hits(df, policy_table(spark).limit(0), "id").count() == 0


def test_hits_in_literals_and_in_data_agree(spark, sf):
    from textsluice.operators.policies import policy_hits_from_table
    from textsluice.plans import catalog as c

    docs = c.planted(spark, sf)
    one = policy_hits(docs, "doc_id", text="t", policies=c.ALL_POLICIES).select("doc_id", "policy", "action")
    other = policy_hits_from_table(docs, policy_table(spark, c.ALL_POLICIES), "doc_id", text="t").select("doc_id", "policy", "action")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_more_own_rules_than_a_mask_holds(spark):
    rules = tuple(Rule("HOUSE", "low", f"Word {i}", rf"\bword{i}\b", ()) for i in range(100))
    texts = ["word0 word59 word60 word99", "word63", "none", "word100", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = {r.id: r for r in detect.validate(df, "t", 100, rules, rules, "<{}>").collect()}
    assert [v.description for v in rows[0].validation.violations] == ["Word 0", "Word 59", "Word 60", "Word 99"]
    assert [rows[i].validation.valid for i in (0, 1, 2, 3)] == [False, False, True, True]
    assert rows[0].n_violations == 4 and rows[0].validation.sanitized == "<HOUSE> <HOUSE> <HOUSE> <HOUSE>"
    assert to_java(rules[0].pattern) and F
