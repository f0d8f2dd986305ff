"""Plans that must hold when the tables grow: no broadcast of node tables, tasks by rows, little kept."""

import pytest
from pyspark.sql import Row

from domlake import rules
from domlake.operators import forms
from domlake.plans import adapters, catalog


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    spark.createDataFrame([
        Row(p_partkey=i, p_name=f"part {i}", p_brand=f"Brand#{i % 5}", p_type="T", p_size=i % 50 + 1, p_retailprice=1.0)
        for i in range(90)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
                             "p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    catalog.load()
    return str(folder)


@pytest.mark.parametrize("name", [
    "t3_id_map", "t4_adjacency", "t10_join_captured_ax", "t16_labelledby", "t21_interactivity_signals",
    "t22_implicit_candidates", "t30_drop_hidden", "t31_filter_noise_text", "t34_compile_captured",
    "l1_detect_layers_markup", "o9_live_region_ancestor", "f2_within_form_groups", "f13_extract_fields",
    "f18_apply_runtime_values", "f19_field_context"])
def test_node_tables_are_not_broadcast(spark, parts, name):
    plan = catalog.QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("documents", [adapters.product_dom, adapters.capture_json])
def test_tasks_follow_the_rows(spark, parts, documents, monkeypatch):
    monkeypatch.setattr(adapters, "DOCUMENTS_A_TASK", 2)
    assert documents(spark, parts).rdd.getNumPartitions() == 45


def test_long_methods_are_not_fused(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalog.prepare(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_forms_keep_only_what_they_read(spark, parts, monkeypatch):
    kept = []
    monkeypatch.setattr(adapters, "materialize", lambda df: kept.append(df) or df)
    catalog.QUERIES["f13_extract_fields"](spark, parts)
    assert "find" not in kept[0].columns
    assert {r.kind for r in kept[0].select("kind").distinct().collect()} == {
        "form", "input", "checkbox", "slider", "combobox", "button"}


def test_intent_reads_its_text_once(spark):
    texts = spark.createDataFrame([("Log in to pay: Payment of your ORDER",), ("",), (None,), ("Sign up",)], "t string")
    got = texts.select("t", forms.infer_intent("t").alias("i"))
    assert got._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert [r.i for r in got.collect()] == [_intent(r.t) for r in texts.collect()]


def _intent(text):
    scores = {i: sum(w for word, w in words if word in (text or "").lower())
              for i, words in rules.INTENT_KEYWORDS.items()}
    top = max(scores.values())
    return next((i for i, v in scores.items() if v == top), "unknown") if top else "unknown"


def test_a_node_is_looked_at_once_for_its_descendants(monkeypatch):
    import pyarrow as pa

    from domlake.sources import html

    seen, hides = [], html.hides
    monkeypatch.setattr(html, "hides", lambda name, attrs: seen.append(name) or hides(name, attrs))
    nodes = html._NodeBatch()
    nodes.start(1)
    html._read_html(nodes, "<div hidden id=a><p role=note title=t>x<b aria-label=l>y</b></p></div>")
    nodes.finish()
    rows = nodes.batch(html._arrow_schema(pa.int64())).to_pylist()
    assert len(seen) == len(rows) == 6
    deep = next(r for r in rows if r["node_value"] == "y")
    assert [(a["tag"], a["role"], a["aria_label"], a["title"], a["html_id"], a["hidden"]) for a in deep["ancestors"]] == [
        ("B", None, "l", None, None, False), ("P", "note", None, "t", None, False),
        ("DIV", None, None, None, "a", True), ("#document", None, None, None, None, False)]


_ODD = [
    (1, "<nav aria-label=Top><ul><li><a href=/x>x</a><li></ul></nav><div hidden><p>no</div><form role=GRID id=f><label>Q<input></label>"
        "<select><optgroup><option>1</select></form><h2>H</h2><aside role=' Banner x'><fieldset title=t><b tabindex=0>y"),
    (2, "<div id=h><template shadowrootmode=open><p>in<button id=a>b</button></template></div><iframe srcdoc='<main><h1>z</h1><ul>"
        "<li>k&amp;</ul>'></iframe><!-- c --><input aria-labelledby='h a'><section><div><span class=Toastify__toast>s <i>t"),
    (3, "text"), (None, "<p role=alert>l<b>ow"), (1, "<p>again"), (4, ""), (5, None),
]


def _odd(spark):
    return spark.createDataFrame(_ODD, "page_id long, html string").coalesce(1)


def _rows(df):
    from pyspark.sql import functions as F

    return sorted(r.j for r in df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).collect())


@pytest.mark.parametrize("columns", [
    ("id", "node_name"), ("id", "parent_id", "node_name", "pre"), ("label_text", "post"), ("near_text", "depth"),
    ("labelledby", "shadow_path"), ("node_value", "frame_path"), ("ancestors",), ("attributes", "compat_forms")])
def test_columns_named_are_those_of_the_whole_table(spark, columns):
    from domlake.sources.html import html_to_dom

    some, whole = html_to_dom(_odd(spark), columns=columns), html_to_dom(_odd(spark))
    assert set(some.columns) == {"snapshot_id", *columns}
    assert _rows(some) == _rows(whole.select("snapshot_id", *columns))


@pytest.mark.parametrize("signals", [False, True])
def test_elements_are_the_same_from_what_ancestors_add_up_to(spark, signals):
    from pyspark.sql import functions as F

    from domlake.plans.compile import compile_elements
    from domlake.schema import ELEMENT_COLUMNS
    from domlake.sources.html import html_to_dom

    whole = html_to_dom(_odd(spark))
    few = html_to_dom(_odd(spark), texts=False, columns=(*ELEMENT_COLUMNS, "ancestor_ids"))
    more = {} if not signals else {
        "listeners": whole.filter("id % 3 = 1").select("snapshot_id", "id", F.lit("click").alias("type")),
        "layouts": whole.filter("id % 2 = 0").select("snapshot_id", "id", *[F.lit(3).alias(c) for c in "xywh"], F.when(
            F.col("id") % 5 == 0, "pointer").alias("cursor"))}
    want = _rows(compile_elements(whole, internals=True, **more))
    assert want and _rows(compile_elements(few, internals=True, **more)) == want


def _parses(df):
    """Columns that each reading of the markup makes."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", cols).split(", ") for cols in re.findall(r"MapInArrow run\([^)]*\)[^,]*, \[([^\]]*)\]", plan)]


@pytest.mark.parametrize("name, times, most", [
    ("t21_interactivity_signals", 1, 10), ("f19_field_context", 0, 0), ("o9_live_region_ancestor", 4, 6),
    ("f2_within_form_groups", 0, 0), ("t16_labelledby", 2, 7), ("t4_adjacency", 2, 5), ("t3_id_map", 2, 6),
    ("t30_drop_hidden", 2, 22), ("t27_extract_attributes", 1, 22), ("t24_extract_state", 1, 22), ("f9_infer_purpose", 1, 22),
    ("t15_group_id", 1, 22), ("l8_format_actionables", 1, 22), ("l1_detect_layers_markup", 3, 22),
    ("t28_build_locators", 1, 22), ("t22_implicit_candidates", 1, 23)])
def test_markup_is_read_for_few_columns(spark, parts, monkeypatch, name, times, most):
    kept = []
    materialize = adapters.materialize
    monkeypatch.setattr(adapters, "materialize", lambda df: kept.append(df) or materialize(df))
    found = _parses(catalog.QUERIES[name](spark, parts))
    assert len(found) == times
    for columns in [*found, *(c for df in kept for c in _parses(df))]:
        assert "ancestors" not in columns and len(columns) <= max(most, 22 if kept else 0)


def test_rows_that_cannot_matter_go_before_the_exchange(spark):
    from domlake.operators import tree
    from domlake.sources.html import html_to_dom

    dom = html_to_dom(spark.createDataFrame([(1, "<div><span><b>x</b><h2>h</h2><b tabindex=0>y</b><ul><i>")], "page_id int, html string"))
    el = tree.with_grouping(tree.interactivity_signals(tree.synthesize(tree.join_dom_ax(tree.with_derived_ax(dom)))))
    assert sorted(r.tag for r in tree.may_matter(el).collect()) == ["B", "H2", "UL"]
