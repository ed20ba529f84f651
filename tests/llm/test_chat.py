import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from ledgerloom.llm import chat
from ledgerloom.llm.chat import CONTROLS, compiled, digests, format_conversations, read_turns
from ledgerloom.llm.templates import Escaper, Template, TemplateError

NASTY = st.lists(st.sampled_from([*CONTROLS, "\\", "<", ">", "[", "/", "]", "s", " ", "\n", "INST", "é", "\\n", ""]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), NASTY), NASTY), max_size=6))
def test_formatted_text_gives_every_turn_back(turns):
    text, spans = compiled().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert list(read_turns(text)) == turns
    said = [Escaper.unescape(text[a:b]) for a, b in spans]
    assert said == [t for r, t in turns if r == "assistant"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\\", max_size=12), st.lists(st.text(alphabet="ab", min_size=2, max_size=3), min_size=1, max_size=3))
def test_escaping_is_reversible_and_leaves_no_control_string(text, controls):
    own = Escaper(controls)
    out = own.escape(text)
    assert Escaper.unescape(out) == text and not any(c in out for c in controls)


@pytest.mark.parametrize(
    "source, values, expected",
    [
        ("a{{ 'b' ~ 1 + 2 }}c", {}, "ab12c"),
        ("{{ 1 + 2 }}|{{ 7 % 4 }}|{{ 'x' + 1 }}", {}, "3|3|x1"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{% for x in xs %}{% for y in x %}{{ y }}{{ loop.first }}{% endfor %}{{ loop.index0 }};{% endfor %}", {"xs": [["a"], ["b", "c"]]}, "atrue0;btruecfalse1;"),
        ("{% if a and b or c %}1{% elif d is defined %}2{% else %}3{% endif %}", {"a": 1, "b": 0, "c": ""}, "3"),
        ("{% set n = 'v' %}{{ n|upper }} {{ m.k['j'] }}{{ m.none_such }}{{ xs[0] }}{{ xs[9] }}", {"m": {"k": {"j": "w"}}, "xs": ["q"]}, "V wq"),
        ("  {{- ' a ' | trim -}}  b {#- gone -#} {%- if 'x' in 'xy' %} c{% endif %}", {}, "ab {#- gone -#} c".replace(" {#- gone -#}", "") ),
        ("{{ 'a' if t else 'b' }}{{ 'c' if t }}", {"t": 0}, "b"),
        ("{{ x | default('d') }}{{ 'abc' | replace('b', 'x') | length }}", {}, "d3"),
        ("{{ 1 < 2 and 'a' < 'b' and 2 not in xs }}", {"xs": [1]}, "true"),
    ],
)
def test_language(source, values, expected):
    assert Template(source).render(**values)[0] == expected


@pytest.mark.parametrize("source", ["{{ a.__class__.x() }}", "{% for x in y %}", "{{ 'a }}", "{{ a | nothing }}", "{% import os %}", "{% endif %}", "{{ a b }}", "{{", "{% if x %}{% else %}{% elif y %}{% endif %}", "{{ (" * 1 + "(" * 80 + "1" + ")" * 81 + " }}", "{% set loop = 1 %}", "{{ 1 < 'a' }}"])
def test_templates_that_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source).render(a="x", y=[1], x=1)


def test_sandbox_and_limit():
    class Thing:
        secret = "s"

    for source in ("{{ x.secret }}", "{{ x }}", "{% for y in x %}{% endfor %}"):
        with pytest.raises(TemplateError):
            Template(source).render(x=Thing())
    assert Template("{{ x.upper }}{{ x.__class__ }}").render(x="a")[0] == ""
    with pytest.raises(TemplateError, match="more than 5"):
        Template("{% for x in xs %}abc{% endfor %}", most_characters=5).render(xs=[1, 2])
    with pytest.raises(TemplateError, match="inside another"):
        Template("{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}").render()


def test_constants_are_folded():
    assert Template("a{{ 'b' | upper }}{% if 1 > 2 %}no{% elif true %}c{{ 1 + 1 }}{% else %}no{% endif %}").tree == ("block", (("text", "aBc2"),))
    tree = Template("{{ 'x' ~ 'y' ~ n }}z").tree
    assert tree == ("block", (("text", "xy"), ("show", ("name", "n")), ("text", "z")))


def test_pieces_leave_before_the_next_turn_is_read():
    read = []

    def items():
        for i in range(4):
            read.append(i)
            yield {"t": f"<{i}>"}

    out = []
    for text, starts, ends in Template("{% for m in ms %}{% generation %}{{ m.t }}{% endgeneration %}{% endfor %}.").pieces(ms=items()):
        out.append((text, starts, ends, len(read)))
    assert out == [("<0>", [0], [3], 2), ("<1>", [3], [6], 3), ("<2>", [6], [9], 4), ("<3>", [9], [12], 4), (".", [], [], 4)]


EDGE = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x\\</s>"), (2, None, "system", ""), (2, 5, "assistant", "[INST"), (2, 5, "assistant", "[INST"),
    (None, 0, "user", "no id"), (3, 1, "assistant", "é" * 70_000), (3, 0, "User", " [/INST] "), (4, 0, "assistant", "only"), *((5, i, ["user", "assistant"][i % 2], f"</s>{i}\\" * 40) for i in range(300)),
]


def expected(rows):
    out, by = set(), {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        everything = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out.add((c, len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part", [1_000_000, 300])
def test_edges_and_parts(spark, part, tmp_path):
    rows = spark.createDataFrame([(*r, 1, "q") for r in EDGE], "conv_id long, turn long, role string, text string, part int, last string").repartition(3)
    made = format_conversations(rows) if part == 1_000_000 else _cut(format_conversations(rows), part)
    made.write.parquet(f"{tmp_path}/made")
    back = spark.read.parquet(f"{tmp_path}/made")
    got = digests(back).collect()
    assert {tuple(r)[:5] for r in got} == expected(EDGE) and len(got) == len({r[0] for r in EDGE})
    sizes = {r.conv_id: r.formatted_chars for r in got}
    assert sizes == {r.conv_id: r.n for r in back.selectExpr("conv_id", "length(text) n").groupBy("conv_id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert digests(format_conversations(rows.limit(0))).count() == 0


def _cut(made, size):
    """Parts cut by ``_parts`` with a small limit, as a long conversation is."""
    spark, out = made.sparkSession, []
    old, chat.PART = chat.PART, size
    try:
        for r in made.collect():
            turns = [{"role": a, "text": b} for a, b in read_turns(r.text)]
            for n, (text, starts, ends, last) in enumerate(chat._parts(compiled().pieces(messages=iter(turns)))):
                assert text
                out.append((r.conv_id, n, last, text, starts, ends))
    finally:
        chat.PART = old
    assert max(r[1] for r in out) > 20
    return spark.createDataFrame(out, made.schema).repartition(4)


def test_query_equals_sql(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in EDGE]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = __spark_entry__.queries()["op12_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.execute(__spark_entry__.oracle_sql()["op12_chat_format"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(theirs, key=str)
    assert any(r[0] == -7 and r[1] == 2 and r[3] == 21 for r in theirs)
