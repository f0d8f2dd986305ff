"""Views that give the shared tables the shapes the operators work on.

The SQL texts run unchanged on Spark and on other engines.  Captures in ``BOXES`` hold 400
consecutive parts each, so their number grows with the data while a capture stays page-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import materialize  # noqa: F401
from ..schema import ELEMENT_COLUMNS, bbox, make_nodes
from ..sources.captures import read_pages
from ..sources.html import html_to_dom
from .compile import compile_elements

_EVENTS = ("(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e")

NET = f"""
SELECT event_id AS call_id, user_id AS page_id, ts AS started_at, k,
  'https://h' || CAST(user_id % 7 AS STRING) || '.example/' || event_type || '/'
    || CAST(k AS STRING) AS url,
  CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'fetch'
    WHEN 'error' THEN 'fetch' ELSE 'xhr' END AS resource_type,
  event_type = 'view' AS is_navigation,
  (event_type = 'error' AND k % 2 = 0) AS failed,
  CASE WHEN k % 10 = 9 OR (event_type = 'error' AND k % 2 = 0) THEN NULL
    WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN k % 10 = 9 AND NOT (event_type = 'error' AND k % 2 = 0) THEN NULL
    ELSE ts + INTERVAL '1' SECOND * CAST(floor(value * 60) AS INT) END AS ended_at
FROM {_EVENTS}
"""

MUT = f"""
SELECT event_id AS mut_id, user_id AS page_id, ts,
  CASE WHEN k % 3 = 0 THEN 'removed' ELSE 'added' END AS type,
  CASE event_type WHEN 'signup' THEN 'dialog' WHEN 'click' THEN 'button'
    WHEN 'purchase' THEN 'form' ELSE 'div' END AS tag,
  CASE event_type WHEN 'error' THEN 'alert' WHEN 'signup' THEN 'dialog'
    WHEN 'view' THEN 'status' END AS role,
  CASE WHEN k % 5 = 0 THEN 'polite' END AS aria_live,
  event_type || ' ' || CAST(k % 8 AS STRING) AS text,
  k * 20 AS z_index, k AS width_pct, k % 50 AS height_pct,
  event_type IN ('click','purchase') AS has_interactives, k % 4 = 0 AS is_fixed,
  k % 2 = 0 AS is_body_child, k % 7 <> 0 AS is_visible
FROM {_EVENTS}
"""

CAPS = f"""
SELECT user_id AS page_id, CAST(floor((day(ts) - 1) / 5) AS INT) AS step,
  event_type || '-' || CAST(k % 6 AS STRING) AS node_id, k % 6 AS slot,
  CASE event_type WHEN 'view' THEN 'link' WHEN 'click' THEN 'button' WHEN 'signup' THEN 'input'
                  WHEN 'purchase' THEN 'checkbox' ELSE 'alert' END AS kind,
  event_type || ' (' || CAST(count(*) AS STRING) || ')' AS label,
  CASE WHEN k % 6 = 0 THEN 'nav' WHEN k % 6 < 4 THEN 'main' ELSE 'footer' END AS region,
  max(k) % 5 <> 0 AS visible, max(k) % 2 = 0 AS enabled,
  CAST(CAST(floor(max(value)) AS INT) AS STRING) AS value,
  CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'status' END AS role
FROM {_EVENTS}
GROUP BY user_id, CAST(floor((day(ts) - 1) / 5) AS INT), event_type, k % 6
"""

BOXES = """
SELECT CAST(floor(p_partkey / 400) AS BIGINT) AS snapshot_id, p_partkey AS node_id,
  p_name AS label,
  CASE p_partkey % 7 WHEN 0 THEN 'form' WHEN 1 THEN 'button' WHEN 2 THEN 'input'
    WHEN 3 THEN 'select' WHEN 4 THEN 'heading' WHEN 5 THEN 'link' ELSE 'textarea' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN 'nav' WHEN 1 THEN 'dialog' WHEN 2 THEN 'unknown'
    ELSE 'main' END AS region,
  (p_partkey * 37) % 1280 AS x, (p_partkey * 91) % 1440 AS y, 20 + p_size * 4 AS w,
  16 + p_size AS h,
  CASE WHEN p_size % 11 = 0 THEN p_size * 25 END AS z_index,
  CASE p_size % 6 WHEN 0 THEN 'dialog' WHEN 1 THEN 'menu' WHEN 2 THEN 'alert'
    WHEN 3 THEN 'complementary' END AS role
FROM part
"""

FIELDS = """
SELECT o_custkey AS form_id, o_orderkey AS field_id,
  substr(o_orderpriority, 1, 1) IN ('1','2') AS required,
  o_orderstatus = 'F' AS filled, NOT (o_orderstatus = 'P') AS valid, o_orderkey % 9 <> 0 AS enabled
FROM orders
"""


# One product page per part, with the markup the corpus lacks: a form with every kind of control,
# named and unnamed groups, references, a toast, a live region, a shadow tree and a frame.
_S = "CAST(p_size AS STRING)"
_K = "CAST(p_partkey AS STRING)"


def _when(test: str, text: str, other: str = "") -> str:
    return f"CASE WHEN {test} THEN '{text}' ELSE '{other}' END"


PRODUCTS = f"""
SELECT p_partkey AS page_id, p_name, p_brand, p_size,
  '<html lang="en"><head><title>' || p_name || '</title><meta name="author" content="' || p_brand
  || '"></head><body><header><h1 id="top">' || p_name || '</h1></header><main>'
  || '<form id="order" name="order" action="/buy" method="post" aria-label="Order ' || p_brand
  || '"><label for="qty">Quantity ' || {_S} || '</label><input id="qty" type="number" name="qty" '
  || 'value="' || {_S} || '"' || {_when('p_size % 2 = 0', ' required')}
  || {_when('p_size % 3 = 0', ' disabled')} || {_when('p_size % 5 = 0', ' aria-disabled="false"')}
  || '><input type="password" name="pw" placeholder="Secret code" value="abc">'
  || '<input type="checkbox" name="gift"' || {_when('p_size % 4 = 0', ' checked')}
  || ' aria-label="Gift wrap"><input type="email" title="Mail ' || {_S}
  || '" autocomplete="email" aria-invalid="' || {_when('p_size % 2 = 1', 'true', 'false')}
  || '"><input type="submit" value="Buy ' || p_name || '"><select name="color">'
  || '<optgroup label="All"><option selected>Red</option></optgroup><option disabled>Blue</option>'
  || '</select><input type="text" aria-labelledby="ref1 missing ref2">'
  || '<textarea data-testid="note-' || {_K} || '"></textarea><button>Go</button></form>'
  || '<div id="ref1" aria-label="First ' || {_S} || '"></div><div id="ref2" aria-label="Second">'
  || '</div><div class="col card" data-testid="card" tabindex="'
  || {_when('p_size % 2 = 0', '0', '-1')} || '">Card</div><img alt="Photo of ' || p_name
  || '" src="https://img.example/' || {_K} || '.png?x=1"><a href="https://shop.example/p/' || {_K}
  || '?token=abc&amp;page=2" class="container">Details</a><div class="Toastify__toast">Saved '
  || {_S} || '</div><div role="alert"><span>Low stock <b>' || {_S} || '</b></span></div>'
  || '<canvas aria-label="Chart"></canvas><h2>Related</h2><ul><li></li></ul>'
  || '<ol aria-label="Steps"><li>One<li>Two</ol><div id="host"><template shadowrootmode="open">'
  || '<button id="top">Inside</button></template></div><iframe srcdoc="&lt;p id=top&gt;Framed'
  || '&lt;/p&gt;&lt;h3&gt;In frame&lt;/h3&gt;&lt;a href=/x&gt;x&lt;/a&gt;"></iframe><p>After</p>'
  || '</main><footer>' || p_brand || '</footer></body></html>' AS html
FROM part
"""


def _text(node_id: str, value: str) -> str:
    """A text node inside a quoted SQL text, with its value spliced in."""
    return ('{"nodeId":0,"backendNodeId":' + node_id + ',"nodeType":3,"nodeName":"#text",'
            '"nodeValue":"\' || ' + value + ' || \'"}')


# The same kind of page as capture JSON: document tree, accessibility rows, frame tree.
CAPTURES = f"""
SELECT p_partkey AS snapshot_id, p_name, p_brand, p_size,
  '{{"root":{{"nodeId":1,"backendNodeId":1,"nodeType":9,"nodeName":"#document","frameId":"F1",'
  || '"children":[{{"nodeId":2,"backendNodeId":10,"nodeType":1,"nodeName":"MAIN","attributes":'
  || '["id","m"],"children":[{{"nodeId":3,"backendNodeId":11,"nodeType":1,"nodeName":"BUTTON",'
  || '"attributes":["class","btn wide"],"children":[{_text('12', 'p_name')}]}},'
  || '{{"nodeId":4,"backendNodeId":20,"nodeType":1,"nodeName":"DIV","attributes":["id","host"],'
  || '"children":[{{"nodeId":5,"backendNodeId":23,"nodeType":1,"nodeName":"SPAN","children":'
  || '[{_text('24', "'light'")}]}}],"shadowRoots":[{{"nodeId":6,"backendNodeId":21,"nodeType":11,'
  || '"nodeName":"#document-fragment","shadowRootType":"open","children":[{{"nodeId":7,'
  || '"backendNodeId":22,"nodeType":1,"nodeName":"INPUT","attributes":["type","text","name","n'
  || {_S} || '"]}}]}}]}},{{"nodeId":8,"backendNodeId":30,"nodeType":1,"nodeName":"IFRAME",'
  || '"frameId":"F2","contentDocument":{{"nodeId":9,"backendNodeId":31,"nodeType":9,'
  || '"nodeName":"#document","frameId":"F2","children":[{{"nodeId":10,"backendNodeId":32,'
  || '"nodeType":1,"nodeName":"H2","frameId":"F2","children":[{_text('33', 'p_brand')}]}}]}}}}]}}]'
  || '}}}}' AS dom_json,
  '{{"nodes":[{{"nodeId":"1","backendDOMNodeId":10,"role":{{"value":"main"}},"name":{{"value":'
  || '"Main ' || p_brand || '"}}}},{{"nodeId":"2","backendDOMNodeId":11,"role":{{"value":"button"'
  || '}},"name":{{"value":"' || p_name || '"}},"properties":[{{"name":"disabled","value":{{"value":'
  || {_when('p_size % 2 = 0', 'true', 'false')} || '}}}}]}},{{"nodeId":"3","backendDOMNodeId":20,'
  || '"ignored":true,"role":{{"value":"none"}}}},{{"nodeId":"4","backendDOMNodeId":22,"role":'
  || '{{"value":"textbox"}},"name":{{"value":""}},"properties":[{{"name":"focused","value":'
  || '{{"value":' || {_when('p_size % 3 = 0', 'true', 'false')} || '}}}},{{"name":"invalid","value":'
  || '{{"value":"spelling"}}}}]}},{{"nodeId":"5","backendDOMNodeId":32,"role":{{"value":"heading"'
  || '}},"name":{{"value":"Frame ' || {_S} || '"}},"properties":[{{"name":"level","value":{{"value":'
  || '2}}}}]}},{{"nodeId":"6","role":{{"value":"link"}},"name":{{"value":"no dom"}}}},{{"nodeId":'
  || '"7","backendDOMNodeId":23,"role":{{"value":"generic"}}}},{{"nodeId":"8","backendDOMNodeId":'
  || '24,"role":{{"value":"StaticText"}},"name":{{"value":"light"}}}}]}}' AS ax_json,
  '{{"frame":{{"id":"F1","loaderId":"L' || {_K} || '"}},"childFrames":[{{"frame":{{"id":"F2",'
  || '"parentId":"F1"' || {_when('p_size % 2 = 0', ',"loaderId":"LX"')} || '}}}}]}}' AS frame_json
FROM part
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for text-heavy work: an input of fewer splits than cores is spread out first."""
    docs, want = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= want else docs.repartition(want, "doc_id")


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: table(spark, sf_dir, name)})


def net_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, NET, "events")


def net_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call view as an event feed: a request row and, where it ended, a completion row."""
    calls = net_calls(spark, sf_dir)
    request = F.struct(F.lit("request").alias("event"), F.col("started_at").alias("ts"))
    ending = F.struct(F.when(F.col("failed"), "failed").otherwise("finished").alias("event"),
                      F.col("ended_at").alias("ts"))
    return calls.select(
        "page_id", F.col("call_id").alias("request_id"), "url", "method", "resource_type",
        "is_navigation", "status",
        F.explode(F.array_compact(F.array(
            request, F.when(F.col("ended_at").isNotNull(), ending)))).alias("x")).select(
        "page_id", "request_id", "x.event", "x.ts", "url", "method", "resource_type",
        "is_navigation", F.when(F.col("x.event") == "finished", F.col("status")).alias("status"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MUT, "events")


def click_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as user actions (page_id, action_id, ts)."""
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("action_id"), "ts")


def capture_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the capture view; document order is the order of (kind, node_id)."""
    v = _view(spark, sf_dir, CAPS, "events")
    rank = F.expr("row_number() OVER (PARTITION BY page_id, step ORDER BY kind, node_id)")
    v = v.withColumn("rank", rank).withColumn(
        "snapshot_id", F.concat_ws("-", F.col("page_id"), F.col("step")))
    return make_nodes(
        v, keys=["snapshot_id", "page_id", "step"], node_id=F.col("node_id"), kind=F.col("kind"),
        label=F.col("label"), doc_order=F.col("rank"),
        where={"region": F.col("region"), "group_path": F.array("region")},
        state={"visible": F.col("visible"), "enabled": F.col("enabled")},
        attributes={"value": F.col("value"), "role": F.col("role")})


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (page_id, step) of the capture view."""
    e = table(spark, sf_dir, "events")
    step = F.floor((F.day("ts") - 1) / 5).cast("int").alias("step")
    return e.groupBy(F.col("user_id").alias("page_id"), step).agg(
        F.max("ts").alias("captured_at"), F.count("*").alias("events")).withColumn(
        "url", F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"))
    ).withColumn("title", F.concat(F.lit("Page "), F.col("page_id").cast("string"))).withColumn(
        "snapshot_id", F.concat_ws("-", F.col("page_id"), F.col("step")))


def box_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, BOXES, "part")
    return make_nodes(
        v, keys=["snapshot_id"], node_id=F.col("node_id"), kind=F.col("kind"),
        label=F.col("label"), doc_order=F.col("node_id"),
        where={"region": F.col("region")},
        layout={"bbox": bbox("x", "y", "w", "h"), "z_index": F.col("z_index")},
        state={"visible": F.lit(True), "enabled": F.lit(True)},
        attributes={"role": F.col("role")})


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FIELDS, "orders")


_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _plan(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The compile plan is the same for every query over a table, so it is put together once per
    application.  Only the plan is kept, never its rows."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def corpus(spark: SparkSession, sf_dir: str, texts: bool = True, columns=None) -> DataFrame:
    """Document rows of the page corpus."""
    return html_to_dom(read_pages(spark, f"{sf_dir}/pages.parquet"), texts=texts, columns=columns)


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "corpus", lambda: compile_elements(
        corpus(spark, sf_dir, texts=False, columns=ELEMENT_COLUMNS)).withColumn("page_id", F.col("snapshot_id")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PRODUCTS, "part")


#: Documents of a task where they are made from rows of a small file.
DOCUMENTS_A_TASK = 4000


def spread(spark: SparkSession, sf_dir: str, documents: DataFrame, key: str) -> DataFrame:
    """Documents made from parts, one each. The file of parts is far smaller than what comes of it, so its splits are
    too few; the number of tasks follows the number of rows."""
    tasks = -(-table(spark, sf_dir, "part").count() // DOCUMENTS_A_TASK)
    return documents.repartition(max(tasks, spark.sparkContext.defaultParallelism), key)


def product_dom(spark: SparkSession, sf_dir: str, texts: bool = True, columns=None) -> DataFrame:
    """Document rows of the product pages; only the ``columns`` named, for those that are not read cost as much."""
    pages = products(spark, sf_dir).select("page_id", "html")
    return html_to_dom(spread(spark, sf_dir, pages, "page_id"), texts=texts, columns=columns)


def product_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "products", lambda: compile_elements(
        product_dom(spark, sf_dir, texts=False, columns=ELEMENT_COLUMNS)))


def capture_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, _view(spark, sf_dir, CAPTURES, "part"), "snapshot_id")
