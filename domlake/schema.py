"""Column layouts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCESTOR = (
    "struct<id:bigint,tag:string,role:string,aria_label:string,title:string,html_id:string,"
    "hidden:boolean,ax_role:string,ax_name:string>"
)
DOM_COLUMNS = (
    "id bigint, parent_id bigint, node_name string, node_type int, "
    "attributes map<string,string>, node_value string, frame_id string, "
    "frame_path array<bigint>, shadow_path array<bigint>, pre int, post int, depth int, "
    f"ancestors array<{ANCESTOR}>, near_text array<struct<d:int,t:string>>, "
    "labelledby string, label_text string, compat_forms map<string,string>"
)
#: What the ancestors of a node in a page of markup add up to; made where a caller names them.
DOM_DIGESTS = (
    "ancestor_ids array<bigint>, in_hidden boolean, "
    f"containers array<{ANCESTOR}>, region_above string, holder_tag string, holder_role string, parent_ax_name string"
)

BBOX = "struct<x:double,y:double,w:double,h:double>"
WHERE = "struct<region:string,group_id:string,group_path:array<string>,heading_context:string>"
LAYOUT = f"struct<bbox:{BBOX},display:string,screen_zone:string,z_index:int>"
STATE = (
    "struct<visible:boolean,enabled:boolean,checked:string,expanded:boolean,selected:boolean,"
    "pressed:boolean,focused:boolean,required:boolean,invalid:boolean,readonly:boolean>"
)
FIND = (
    "struct<primary:string,alternates:array<string>,frame_path:array<string>,"
    "shadow_path:array<string>>"
)
ATTRIBUTES = (
    "struct<input_type:string,placeholder:string,value:string,href:string,alt:string,src:string,"
    "heading_level:int,action:string,method:string,autocomplete:string,name:string,"
    "test_id:string,role:string,extra:map<string,string>>"
)
NODE_COLUMNS = (
    f"node_id string, backend_node_id bigint, frame_id string, loader_id string, kind string, "
    f"label string, where {WHERE}, layout {LAYOUT}, state {STATE}, find {FIND}, "
    f"attributes {ATTRIBUTES}, implicitly_interactive boolean, doc_order bigint"
)
SNAPSHOT_FILE = (
    "snapshot_id string, page_id string, session_id string, step int, url string, title string, "
    "language string, captured_at timestamp, viewport struct<width:int,height:int>, "
    "scroll struct<x:int,y:int>, "
    "meta struct<partial:boolean,warnings:array<string>,node_count:int,interactive_count:int,"
    "capture_duration_ms:bigint>, "
    "nodes array<struct<node_id:string,backend_node_id:bigint,frame_id:string,loader_id:string,"
    f"kind:string,label:string,where:{WHERE},"
    f"layout:struct<bbox:{BBOX},display:string,screen_zone:string,zIndex:int>,"
    f"state:{STATE},find:{FIND},attributes:{ATTRIBUTES},implicitly_interactive:boolean>>"
)


def node_struct(name: str, fields: dict[str, Column]) -> Column:
    """Struct column of the node layout ('where', 'layout', 'state', 'find', 'attributes') with the
    given fields; the others are null."""
    layout = {"where": WHERE, "layout": LAYOUT, "state": STATE, "find": FIND,
              "attributes": ATTRIBUTES}[name]
    out = []
    for field, kind in _fields(layout):
        value = fields.get(field)
        value = F.lit(None) if value is None else value
        out.append(value.cast(kind).alias(field))
    unknown = set(fields) - {f for f, _ in _fields(layout)}
    if unknown:
        raise ValueError(f"unknown {name} fields: {sorted(unknown)}")
    return F.struct(*out)


def column_list(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a list of columns."""
    return [tuple(column.strip().split(" ", 1)) for column in _split(ddl)]


def _fields(layout: str) -> list[tuple[str, str]]:
    """Top-level (name, type) pairs of a struct type string."""
    return [tuple(field.split(":", 1)) for field in _split(layout[len("struct<"):-1])]


def _split(body: str) -> list[str]:
    """Parts of a list of fields; commas inside of a type do not count."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(body + ","):
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return out


#: Columns that elements are compiled from, where roles come from the markup.
ELEMENT_COLUMNS = tuple(name for name, _ in column_list(f"{DOM_COLUMNS}, {DOM_DIGESTS}")
                        if name not in ("node_value", "ancestors", "ancestor_ids"))


def bbox(x, y, w, h) -> Column:
    pick = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(pick, "xywh")])


def make_nodes(
    df: DataFrame,
    *,
    keys: list[str],
    node_id: Column,
    kind: Column,
    label: Column,
    doc_order: Column,
    backend_node_id: Column | None = None,
    where: dict[str, Column] | None = None,
    layout: dict[str, Column] | None = None,
    state: dict[str, Column] | None = None,
    attributes: dict[str, Column] | None = None,
    implicitly_interactive: Column | None = None,
) -> DataFrame:
    """Bring a table of elements into the node layout; ``keys`` are carried along unchanged."""
    none = F.lit(None)
    return df.select(
        *keys,
        node_id.cast("string").alias("node_id"),
        (doc_order if backend_node_id is None else backend_node_id)
        .cast("bigint").alias("backend_node_id"),
        none.cast("string").alias("frame_id"),
        none.cast("string").alias("loader_id"),
        kind.alias("kind"),
        label.alias("label"),
        node_struct("where", where or {}).alias("where"),
        node_struct("layout", layout or {}).alias("layout"),
        node_struct("state", state or {}).alias("state"),
        node_struct("find", {}).alias("find"),
        node_struct("attributes", attributes or {}).alias("attributes"),
        (F.lit(False) if implicitly_interactive is None else implicitly_interactive)
        .alias("implicitly_interactive"),
        doc_order.cast("bigint").alias("doc_order"),
    )
