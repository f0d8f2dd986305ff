"""Documents to elements, on small pages that show one behaviour each."""

from pyspark.sql import functions as F

from domlake.functions import text
from domlake.operators import tree
from domlake.plans.compile import compile_elements
from domlake.sources.html import html_to_dom


def dom_of(spark, *pages):
    rows = [(i, h) for i, h in enumerate(pages)]
    return html_to_dom(spark.createDataFrame(rows, "page_id int, html string"))


def tags(spark, html):
    rows = dom_of(spark, html).orderBy("pre").select("node_name", "depth", "node_value").collect()
    return [(r.node_name if r.node_name != "#text" else r.node_value, r.depth) for r in rows]


def test_unclosed_paragraphs_and_items(spark):
    assert tags(spark, "<p>a<p>b<ul><li>c<li>d</ul>") == [
        ("#document", 0), ("P", 1), ("a", 2), ("P", 1), ("b", 2), ("UL", 1), ("LI", 2), ("c", 3),
        ("LI", 2), ("d", 3)]


def test_table_rows_close_cells(spark):
    got = tags(spark, "<table><tr><td>a<td>b<tr><td>c</table>")
    assert [x for x in got if x[0] in ("TR", "TD")] == [
        ("TR", 2), ("TD", 3), ("TD", 3), ("TR", 2), ("TD", 3)]


def test_script_text_comments_and_entities(spark):
    got = tags(spark, "<script>var t='</p>'<b></script><!-- <i> --><p title='a>b'>x &amp; y")
    assert got == [("#document", 0), ("SCRIPT", 1), ("var t='</p>'<b>", 2), ("#comment", 1),
                   ("P", 1), ("x & y", 2)]


def test_broken_markup_does_not_fail(spark):
    for html in ("<", "<p", "</", "<a href='x>y", "a < b > c", "", "<p></b></i></p></p>", "<!--"):
        assert tags(spark, html)[0] == ("#document", 0)


def test_subtree_bounds(spark):
    dom = dom_of(spark, "<div><p>a</p><p>b<i>c</i></p></div><p>d</p>")
    pairs = tree.ancestors(dom).select("id", "ancestor_id")
    spans = dom.select(F.col("id").alias("ancestor_id"), F.col("pre").alias("lo"),
                       (F.col("post") + F.col("depth")).alias("hi"))
    inside = pairs.join(spans, "ancestor_id").join(dom.select("id", "pre"), "id")
    assert inside.filter("NOT (pre > lo AND pre <= hi)").count() == 0


def labels(spark, html, **options):
    nodes = compile_elements(dom_of(spark, html), **options)
    return {(r.kind, r.label) for r in nodes.select("kind", "label").collect()}


def test_label_sources(spark):
    got = labels(spark, """<label for=a>Name</label><input id=a><label>Wrapped <input type=checkbox>
        </label><input placeholder=' Find  it '><input type=submit value=Go>
        <img alt=Pic src=x.png><select name=size></select><button aria-label=Shut>x</button>""")
    assert got == {("input", "Name"), ("checkbox", "Wrapped"), ("input", "Find it"),
                   ("button", "Go"), ("image", "Pic"), ("combobox", "size"), ("button", "Shut")}


def test_noise_lists_are_dropped(spark):
    got = labels(spark, "<ul><li></li></ul><ul><li><a href=x>y</a></li></ul>")
    assert got == {("list", ""), ("listitem", "y"), ("link", "y")}


def test_budget_prefers_overlays_up_to_a_share(spark):
    rows = [(1, i, 500 if i >= 15 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "snapshot_id int, pre int, z_index int")
    kept = [r.pre for r in tree.overlay_budget(df, 10).orderBy("pre").collect()]
    assert kept == [0, 1, 2, 3, 4, 5, 6, 15, 16, 17]
    assert tree.overlay_budget(df, 20).count() == 20


def test_group_takes_heading_of_unnamed_list(spark):
    nodes = compile_elements(dom_of(
        spark, "<h2>My Links</h2><ul><li><a href=x>y</a></li></ul><nav aria-label='Top Bar'>"
               "<a href=z>w</a></nav>"))
    got = {r.label: (r.g, r.h) for r in nodes.filter("kind = 'link'").select(
        "label", F.col("where.group_id").alias("g"),
        F.col("where.heading_context").alias("h")).collect()}
    assert got == {"y": ("list-my-links", "My Links"), "w": ("navigation-top-bar", "My Links")}


def test_hidden_content_and_deep_trees(spark):
    from domlake.plans.compile import compile_elements
    from domlake.sources.html import html_to_dom
    deep = "<nav>" + "<div>" * 70 + "<a href='/x'>Deep link</a>" + "</div>" * 70 + "</nav>"
    many = "".join(f"<button>b{i}</button>" for i in range(2500)) + "<div tabindex=0>t</div>" * 400
    page = (f"<body>{deep}{many}<div hidden><button>no1</button></div><p aria-hidden=true><button>no2</button></p>"
            "<div style='color:red; display: none'><span><button>no3</button></span></div>"
            "<template><button>no4</button></template><noscript><button>no5</button></noscript>"
            "<button style='display:block'>yes</button><h2>" + "long " * 60 + "end</h2></body>")
    dom = html_to_dom(spark.createDataFrame([(1, "http://x.org/", page)], "page_id long, url string, html string"))
    nodes = compile_elements(dom).cache()
    buttons = [r.label for r in nodes.filter("kind = 'button'").collect()]
    assert len(buttons) == 2501 and "yes" in buttons and not [b for b in buttons if b.startswith("no")]
    assert nodes.filter("kind = 'link' AND label = 'Deep link'").first()["where"].region == "nav"
    assert nodes.filter("implicitly_interactive").count() >= 400
    assert nodes.filter("kind = 'heading'").first().label.endswith("end")
    assert compile_elements(dom, max_nodes=100).count() == 100
    assert dom.filter("node_name = 'TEMPLATE'").count() == 1


def test_names_from_deep_content(spark):
    deep = "<div><div><span><b>{}</b></span></div></div>"
    html = (f"<a href=/x>to {deep.format('the shop')}</a><button><i>{deep.format('Buy')}</i></button>"
            f"<h2>{deep.format('News')}<div><div><div><style>h2 {{}}</style></div></div></div></h2>"
            f"<div role=tab><i>{deep.format('One')}</i></div>")
    dom = dom_of(spark, html)
    names = {r.role: r.name for r in tree.derive_ax(dom).collect()}
    assert {k: names[k] for k in ("link", "button", "heading", "tab")} == {
        "link": "to the shop", "button": "Buy", "heading": "News", "tab": "One"}
    labels = {r.kind: r.label for r in compile_elements(dom).collect()}
    assert labels["link"] == "to the shop" and labels["button"] == "Buy"
    short = tree.with_derived_ax(dom, name_depth=3).filter("ax_role = 'link'").first().ax_name
    assert short == "to"


ODD_PAGES = [
    (1, "<html><body><!-- note --><main><label>Name <b>first</b> <input name=a></label><label>Alone</label><input name=b>"
        "<nav role='  Navigation  menu' aria-label='Top  bar'><ul><li><a href=/x>Go \u200b\u00a0there</a></li><li></li></ul></nav>"
        "<div role=' '><button>  A&amp;B\t</button></div><div role='GROUP' id=g><h2>Head</h2><p>Some \uff21 text</p></div>"
        "<select><optgroup><option>Red</option></optgroup></select><input title='caf\u00e9  x' placeholder='p\x7fq'></main>"
        "<div id=h><template shadowrootmode=open><label for=q>In</label><input id=q></template></div>"
        "<div hidden><a href=/y>no</a></div><iframe srcdoc='&lt;h3&gt;F&lt;/h3&gt;&lt;p&gt;t'></iframe></body></html>"),
    (2, "just text"), (3, ""), (4, None), (4, "<p>one<p>two<label>x<!-- y --></label><textarea>z</textarea>"),
]


def test_pages_without_text_rows(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    dom, bare = html_to_dom(pages), html_to_dom(pages, texts=False)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(bare) == rows(dom.filter("node_type NOT IN (3, 8)")) and dom.filter("node_type = 3").count() > 10
    assert rows(compile_elements(bare)) == rows(compile_elements(dom))


def test_ancestor_roles_follow_the_rule_of_elements(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    up = html_to_dom(pages).select(F.explode("ancestors").alias("a")).select(
        "a.ax_role", "a.role", tree.derived_role(F.col("a.role"), F.upper("a.tag")).alias("want")).collect()
    assert all(r.ax_role == r.want for r in up) and {"navigation", "group", "main", None} <= {r.ax_role for r in up}


def test_unread_places_are_not_worked_out(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    read = compile_elements(html_to_dom(pages, texts=False)).select("label", "where.heading_context")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "where_region" not in plan and "group_path" not in plan and "heading_name" in plan


def test_state_and_locators_are_worked_out_once_or_not_at_all(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, html string")
    nodes = compile_elements(html_to_dom(pages, texts=False))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "aria-disabled" not in plan(nodes.select("label", "where.group_id"))
    assert plan(nodes.select("find")).count('[data-testid="') <= 2  # itself, and whether it is there
    assert all(r.state.visible for r in nodes.select("state").collect())
    group = tree.group_id(F.lit(None).cast("struct<id:long,ax_role:string,role:string,tag:string,ax_name:string,"
                                           "aria_label:string,html_id:string>"), F.lit("One Two"))
    assert spark.range(1).select(group).first()[0] is None


def test_short_text_is_squeezed_alike(spark):
    odd = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", "a\tb", "\x7f", "caf\u00e9", "a\u200bb", "a\u00a0b", "~!", None]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    assert df.filter(~text.squeeze("v").eqNullSafe(text.squeeze_short("v"))).count() == 0
