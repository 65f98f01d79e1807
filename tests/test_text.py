from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from mnemo.config import DEFAULT_RULES, Axis
from mnemo.functions import text as t
from mnemo.plans.curate import segment_rows

C = F.col("c")


def test_tokens_keep_path_characters_and_drop_stop_words_and_numbers(column):
    got = column(t.tokens(C), ["The SLA. of core/a.py is 2200 v2", "", None, "Kuala_Lumpur: 12 12a"])
    assert got == [["sla.", "core/a.py", "v2"], [], [], ["kuala_lumpur", "12a"]]


def test_accented_words_fall_apart(column):
    assert column(t.raw_tokens(C), ["déjà vu"]) == [["d", "j", "vu"]]


def test_keyword_hits_count_each_once_words_whole_phrases_anywhere(column):
    words = ["sla", "core network", "ran"]
    got = column(t.keyword_hits(C, words), [
        "SLA sla for the score network", "the sla. of Iran", "ran, core  network", None,
    ])
    assert got == [2, 0, 1, 0]


def test_primary_keyword_is_the_first_of_the_longest(column):
    assert column(t.primary_keyword(C), ["abc abcd wxyz with", "a bc", None]) == ["abcd", "", ""]


def test_segments_split_sentences_and_drop_short_ones(column):
    got = column(t.segments(C), [
        "This one is long enough. No. Another that is long enough!\nA third line that is kept", None, "short",
    ])
    assert got == [
        ["This one is long enough.", "Another that is long enough!", "A third line that is kept"], [], [],
    ]


def test_fences_stay_whole(column):
    code = "```python\ndef build():\n    return 1. Then more\n```"
    got = column(t.segments(C), [f"Here is the code you want:\n{code}\nAnd that is the end of it.", "```open fence. Not closed\n\nat all"])
    assert got[0] == ["Here is the code you want:", code, "And that is the end of it."]
    assert got[1] == ["```open fence. Not closed\n\nat all"]


def test_long_parts_are_cut_and_short_tails_dropped(column):
    got = column(t.segments(C), ["x" * 1500, "y" * 1210, "z" * 1200, "w" * 600])
    assert [[len(s) for s in row] for row in got] == [[600, 600, 300], [600, 600], [600, 600], [600]]


def test_unicode_spaces_count_as_spaces(column):
    assert column(t.strip(C), [" \xa0a b\x1f\n"]) == ["a b"]


def test_classification(column):
    kinds = t.classify(t.class_scores(C))
    got = column(kinds, [
        "pkg/builder.py imports pkg/store.py", "Every folder of the repo holds one module",
        "from pkg.rules import embed", "  \n import os", "They prefer short answers",
        "Their timezone is UTC+8", "nothing to see", "def main( argv )", "class Thing:",
        "see /etc/hosts for it", "é.py",
    ])
    assert got == ["experience"] * 4 + ["knowledge"] * 3 + ["experience"] * 4


def test_class_scores_weigh_patterns_twice(column):
    row = column(t.class_scores(C), ["import x and pkg/a.py, always"])[0]
    # 'import' as keyword, the import line and the file name as patterns.
    assert (row.experience, row.knowledge) == (1 + 2 + 2, 1)


def test_axis_scores_saturate_and_rank(column):
    scores = column(t.axis_scores(C), ["RFP and SLA for the customer", "api latency of the vector model", "hello"])
    assert scores == [{"telco_presales": 0.75}, {"technologist": 0.64}, {}]
    order = column(t.active_axes(t.axis_scores(C)), ["ssh via the api", "zfs for the rfp", "x"])
    assert order == [["linux_pro", "technologist"], ["linux_pro", "telco_presales"], []]


def test_gated_axes_need_experience(column):
    text = ["roadmap and pricing"]
    assert column(t.axis_scores(C, kind=F.lit("knowledge")), text) == [{}]
    assert set(column(t.axis_scores(C, kind=F.lit("experience")), text)[0]) == {"cto", "founder"}
    assert set(column(t.axis_scores(C), text)[0]) == {"cto", "founder"}


def test_a_new_axis_is_data_only(column):
    rules = DEFAULT_RULES.with_(axes=DEFAULT_RULES.axes + (Axis("legal", ("contract", "due diligence"), 0.6),))
    assert column(t.axis_scores(C, rules), ["Due Diligence on the contract"]) == [{"legal": 0.4}]


def test_entities_files_first_then_modules(column):
    got = column(t.entities(C), ["import os.path\nuse a/b.py and a/b.py, data.sqlite3 then é/ü.md", "none here"])
    assert got == [["a/b.py", "data.sqlite3", "é/ü.md", "os.path"], []]


def test_first_matching_relation_wins(column):
    got = column(t.relation_cue(C), [
        "X Imports Y and calls Z", "a depends on b", "it invokes", "inherits from", "persisted", "stores into a db",
        "loads from disk", "covers it", "has one", "wired to", "nothing",
    ])
    assert got == ["imports", "depends_on", "calls", "extends", "mentions", "writes_to", "reads_from", "tests",
                   "contains", "uses", "mentions"]


def test_triples(column):
    got = column(t.triples(C), [
        "a.py imports b.py and c.py", "a.py writes to the storage layer", "plain prose", "a.py writes",
    ])
    flat = [[(x.src, x.rel, x.dst) for x in row] for row in got]
    assert flat == [
        [("a.py", "imports", "b.py"), ("a.py", "imports", "c.py")],
        [("a.py", "writes_to", "storage")], [], [],
    ]


def test_truncate_prefers_a_space_and_never_exceeds(column):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    assert column(t.truncate(C, 40), [text, "short", None]) == ["alpha beta gamma delta ...[truncated]", "short", ""]
    assert column(t.truncate(C, 40), ["x" * 60]) == ["x" * 25 + " ...[truncated]"]
    assert column(t.truncate(C, 5), [text]) == ["alpha"]
    assert column(t.truncate(C, 0), [text]) == [""]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .\né`", max_size=80), min_size=1, max_size=30), st.integers(-1, 70))
def test_truncate_bound_holds_for_any_text(column, texts, limit):
    for whole, cut in zip(texts, column(t.truncate(C, limit), texts)):
        assert len(cut) <= max(limit, 0)
        assert cut == whole or len(whole) > limit


def test_bullets_and_estimates(column):
    assert column(t.bullet(F.lit("knowledge"), C), ["x"]) == ["- [K] x\n"]
    assert column(t.bullet(F.lit("experience"), C), ["x"]) == ["- [E] x\n"]
    assert column(t.token_estimate(C), ["", "x" * 9]) == [1, 2]
    assert column(t.token_estimate_all(F.array(C, C)), ["x" * 7, "x"]) == [2, 1]


def test_messages_to_segments_skip_roles(spark):
    rows = [(1, "user", "The rule is to keep every limit as it is.", None, "a"),
            (2, "tool", "pkg/a.py imports pkg/b.py for reasons", None, "a"),
            (3, None, "pkg/a.py imports pkg/b.py for reasons", None, "a")]
    messages = spark.createDataFrame(rows, "ord int, role string, content string, ts string, source string")
    out = segment_rows(messages, ["ord"], DEFAULT_RULES.with_(skip_roles=("tool",))).orderBy("ord").collect()
    assert [(r.ord, r.role, r.kind) for r in out] == [(1, "user", "knowledge"), (3, "unknown", "experience")]
    assert [tuple(x) for x in out[1].relations] == [("pkg/a.py", "imports", "pkg/b.py")]
