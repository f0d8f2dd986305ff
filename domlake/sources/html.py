"""HTML and capture-JSON sources: one row per document node.

Python only tokenises a document and keeps the open-element stack.  Everything after that
(labels, regions, groups, headings, queries) works on the resulting table.
"""

from __future__ import annotations

import html as _html
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import GROUPING_ROLES, GROUPING_TAGS, ROLE_TO_REGION, TAG_ROLE, TAG_TO_REGION
from ..schema import DOM_COLUMNS, DOM_DIGESTS, column_list

# Levels down to which text is stored with elements that are not named by their content.
NEAR_TEXT_DEPTH = 3
FLUSH_NODES = 20_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<[!?][^>]*+>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTR = re.compile(
    r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+"""
)
_VOID = frozenset(
    "AREA BASE BR COL EMBED HR IMG INPUT LINK META PARAM SOURCE TRACK WBR".split()
)
# Scripts run in the captured pages, so what is in NOSCRIPT is text to the parser.
_RAW = frozenset("SCRIPT STYLE XMP IFRAME NOEMBED NOFRAMES NOSCRIPT".split())
_RCDATA = frozenset("TITLE TEXTAREA".split())
_RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in sorted(_RAW | _RCDATA)
}
_HEAD_ONLY = frozenset("META TITLE STYLE SCRIPT LINK BASE NOSCRIPT TEMPLATE".split())
_CLOSES_P = frozenset(
    "ADDRESS ARTICLE ASIDE BLOCKQUOTE CENTER DETAILS DIALOG DIR DIV DL FIELDSET FIGCAPTION FIGURE "
    "FOOTER FORM H1 H2 H3 H4 H5 H6 HEADER HGROUP HR MAIN MENU NAV OL P PRE SEARCH SECTION SUMMARY "
    "TABLE UL LI DD DT".split()
)
_SCOPE = frozenset("HTML TABLE TD TH CAPTION BUTTON OBJECT TEMPLATE #document "
                   "#document-fragment".split())
_HEADINGS = frozenset("H1 H2 H3 H4 H5 H6".split())
_INLINE = frozenset(
    "A ABBR B BIG CITE CODE EM FONT I KBD LABEL MARK Q S SMALL SPAN STRIKE STRONG SUB SUP TT U VAR"
    .split()
)
_CONTROLS = frozenset("BUTTON INPUT METER OUTPUT PROGRESS SELECT TEXTAREA".split())
_TABLE_PARTS = frozenset("TABLE TBODY THEAD TFOOT #document #document-fragment".split())
# Elements whose short text can become a name; only these carry ``near_text`` for HTML pages, so
# the text of large containers is not stored again at every level.
_NAMED = frozenset(
    "A BUTTON CAPTION DT FIGCAPTION H1 H2 H3 H4 H5 H6 LABEL LEGEND LI OPTION OUTPUT SUMMARY TD TH"
    .split()
)
_UNSPOKEN = frozenset("SCRIPT STYLE TEMPLATE NOSCRIPT".split())
# Opening one of these closes the listed open elements, looking no further than the stop set.
_AUTO_CLOSE = {
    "LI": (frozenset({"LI"}), _SCOPE | {"UL", "OL", "MENU"}),
    "DT": (frozenset({"DT", "DD"}), _SCOPE | {"DL"}),
    "DD": (frozenset({"DT", "DD"}), _SCOPE | {"DL"}),
    "OPTION": (frozenset({"OPTION"}), _SCOPE | {"SELECT", "OPTGROUP", "DATALIST"}),
    "OPTGROUP": (frozenset({"OPTION", "OPTGROUP"}), _SCOPE | {"SELECT"}),
    "TR": (frozenset({"TR"}), _TABLE_PARTS),
    "TD": (frozenset({"TD", "TH"}), _TABLE_PARTS | {"TR"}),
    "TH": (frozenset({"TD", "TH"}), _TABLE_PARTS | {"TR"}),
    "TBODY": (frozenset({"TBODY", "THEAD", "TFOOT"}), frozenset({"TABLE", "#document"})),
    "THEAD": (frozenset({"TBODY", "THEAD", "TFOOT"}), frozenset({"TABLE", "#document"})),
    "TFOOT": (frozenset({"TBODY", "THEAD", "TFOOT"}), frozenset({"TABLE", "#document"})),
    "A": (frozenset({"A"}), _SCOPE),
    "BUTTON": (frozenset({"BUTTON"}), frozenset({"TABLE", "#document"})),
}


_GROUPING_ROLES, _GROUPING_TAGS = frozenset(GROUPING_ROLES), frozenset(GROUPING_TAGS)
_NO_ATTRIBUTES: dict[str, str] = {}  # of every node without any; never written to


class BrokenCapture(ValueError):
    """A document tree that cannot be read."""


class _NodeBatch:
    """Nodes of the table under construction, plus the stack of open ones.

    A node is one tuple: id, row of its parent, name, type, attributes, value, frame id, frame path, shadow path, place in
    the order, depth. What few nodes have is kept by row. ``columns`` are those that are made, all by default."""

    def __init__(self, texts: bool = True, columns=None) -> None:
        self._texts = texts
        wanted = lambda *names: columns is None or any(n in columns for n in names)
        self._near_wanted, self._labels_wanted = wanted("near_text"), wanted("label_text")
        self._references_wanted = wanted("labelledby")
        #: Whether text is read, as a value or by what it is in, and whether attributes are.
        self.reads_text = self._near_wanted or self._labels_wanted or texts and wanted("node_value")
        self.reads_attributes = wanted("attributes", "compat_forms", "ancestors", "near_text", "labelledby", "label_text",
                                       *(name for name, _ in column_list(DOM_DIGESTS) if name != "ancestor_ids"))
        self.reset()

    def reset(self) -> None:
        self.rows: list[tuple] = []
        self.post: list[int] = []
        self.near: dict[int, list] = {}
        self.labelledby: dict[int, str] = {}
        self.label_text: dict[int, str] = {}
        self._documents: list[tuple[int, object]] = []

    def start(self, key, text_everywhere: bool = False) -> None:
        self._text_everywhere = text_everywhere
        self._pre, self._stack = 0, []
        self._first = len(self.rows)
        self._documents.append((self._first, key))
        self._labels: list[tuple[int, list]] = []
        self._open_labels: list[tuple[int, list]] = []

    def drop(self) -> None:
        """Forget the document that was started last."""
        del self.rows[self._first:], self.post[self._first:], self._documents[-1]
        for few in (self.near, self.labelledby, self.label_text):
            for row in [r for r in few if r >= self._first]:
                del few[row]

    def open(self, name, node_type, attrs=None, value=None, node_id=None, frame_id=None,
             frame_path=(), shadow_path=()) -> int:
        """Add a node under the innermost open one and leave it open."""
        stack, row, pre = self._stack, len(self.rows), self._pre
        attrs = attrs or _NO_ATTRIBUTES
        self.rows.append((pre + 1 if node_id is None else node_id, stack[-1][0] if stack else -1, name, node_type, attrs,
                          value, frame_id, frame_path, shadow_path, pre, len(stack)))
        self.post.append(0)
        self._pre = pre + 1
        stack.append([row, name, attrs, None])
        if name == "LABEL":
            label = (row, [])
            self._labels.append(label)
            self._open_labels.append(label)
        if node_type == 3 and value and self.reads_text:
            text = _compat_text(value)
            if text:
                self._spread_text(text, 0)
        return row

    def aside(self, node_type: int, value: str, frame_path: tuple, shadow_path: tuple) -> None:
        """A text node or comment of a page. Where texts get no rows, it still has its place in the order and hands its
        text to what it is in."""
        if self._texts:
            self.leaf("#text" if node_type == 3 else "#comment", node_type, value=value, frame_path=frame_path,
                      shadow_path=shadow_path)
            return
        self._pre += 1
        if node_type == 3 and self.reads_text and (text := _compat_text(value)):
            self._spread_text(text, 1)

    def _spread_text(self, text: str, d: int) -> None:
        """Hand a text to the open nodes; ``d`` is the level of the innermost: 0 if that is the text itself."""
        for _, parts in self._open_labels:
            parts.append(text)
        if not self._near_wanted:
            return
        stack, near = self._stack, self.near
        inside = stack[d - 2][1] if len(stack) > 1 - d else ""
        for entry in reversed(stack):
            row, name, attrs, takes = entry
            if takes is None:
                # 2: named by its content, has all of its text; 1: the near text
                takes = entry[3] = 2 if name in _NAMED or "role" in attrs else 1 if (
                    self._text_everywhere or attrs and ("aria-live" in attrs or "toast" in attrs.get("class", "").lower()
                                                        or "ant-message" in attrs.get("class", "")
                                                        or "data-sonner-toast" in attrs or "data-hot-toast" in attrs)) else 0
            if takes and (d <= NEAR_TEXT_DEPTH or takes == 2 and inside not in _UNSPOKEN):
                if row in near:
                    near[row].append((d, text))
                else:
                    near[row] = [(d, text)]
            if name == "#document" or name == "#document-fragment":
                break  # a frame or shadow tree is not light content of its host
            d += 1

    def finish(self) -> None:
        """Resolve references between the nodes of the document that just ended: labels of form
        controls and aria-labelledby, both within one frame and shadow scope."""
        rows = self.rows
        wanted = [r for r in range(self._first, len(rows)) if rows[r][4] and "aria-labelledby" in rows[r][4]
                  ] if self._references_wanted else []
        labels = self._labels if self._labels_wanted else []
        if not wanted and not labels:
            return
        by_id = {(*rows[r][7:9], rows[r][4]["id"]): r
                 for r in range(self._first, len(rows)) if rows[r][4] and rows[r][4].get("id")}
        for row in wanted:
            refs = (by_id.get((*rows[row][7:9], i)) for i in rows[row][4]["aria-labelledby"].split())
            parts = (" ".join(rows[r][4].get("aria-label", "").split()) or rows[r][5]
                     for r in refs if r is not None)
            self.labelledby[row] = " ".join(p for p in parts if p) or None
        for row, parts in labels:
            attrs = rows[row][4]
            target = by_id.get((*rows[row][7:9], attrs.get("for")))
            if target is None and "for" not in attrs:
                last = self.post[row] + rows[row][10]  # place of the last node in the label
                inside = takewhile(lambda r: rows[r][9] <= last, range(row + 1, len(rows)))
                target = next((r for r in inside if rows[r][2] in _CONTROLS), None)
            if target is not None and parts and self.label_text.get(target) is None:
                self.label_text[target] = " ".join(" ".join(parts).split())

    def close(self) -> None:
        stack = self._stack
        row = stack.pop()[0]
        # Of the nodes so far, those that are closed come before it.
        self.post[row] = self._pre - len(stack) - 1
        if self._open_labels and self._open_labels[-1][0] == row:
            self._open_labels.pop()

    def leaf(self, *args, **kwargs) -> int:
        row = self.open(*args, **kwargs)
        self.close()
        return row

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The nodes as a table of the columns in ``schema``."""
        rows, size = self.rows, len(self.rows)
        ids, up, names, types, attrs, values, frame_ids, frame_paths, shadow_paths, pres, depths = zip(*rows)
        parents, depth = np.array(up, np.int64), np.array(depths, np.int64)
        id_column = pa.array(ids, pa.int64())

        def longs(paths):
            return pa.ListArray.from_arrays(_offsets(paths), pa.array(list(chain.from_iterable(paths)), pa.int64()))

        def keys():
            first = [f for f, _ in self._documents]
            made = pa.array([k for _, k in self._documents], schema.field("snapshot_id").type)
            return made.take(pa.array(np.repeat(np.arange(len(first)), np.diff([*first, size]))))

        def few(by_row):
            return pa.array(map(by_row.get, range(size)), pa.string(), size=size)

        def known():
            # What descendants know of a node is made once and taken by row number.
            own = {k: pa.array([m.get(k) if m else None for m in attrs], pa.string())
                   for k in ("role", "aria-label", "title", "id")}
            return pa.StructArray.from_arrays(
                [
                    id_column, pa.array(names, pa.string()), *own.values(),
                    pa.array([hides(n, m) for n, m in zip(names, attrs)], pa.bool_()),
                    pa.array([role_from_markup(n, m.get("role") if m else None) for n, m in zip(names, attrs)],
                             pa.string()),
                    own["aria-label"],
                ],
                names=["id", "tag", "role", "aria_label", "title", "html_id", "hidden", "ax_role", "ax_name"],
            )

        def above(values):
            """Lists of the values of all ancestors, nearest first."""
            ends = np.concatenate(([0], np.cumsum(depth)))
            flat = np.empty(ends[-1], np.int64)
            left, level = np.flatnonzero(depth), 0
            at = parents[left]
            while len(left):  # one level up at a time
                flat[ends[left] + level] = at
                level += 1
                more = depth[left] > level
                left, at = left[more], parents[at[more]]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(flat)))

        def containers():
            """Grouping ancestors, nearest first; a list is shared until one joins it."""
            lists = []
            for p in up:
                lists.append(() if p < 0 else (p, *lists[p]) if groups(names[p], attrs[p]) else lists[p])
            flat = pa.array(list(chain.from_iterable(lists)), pa.int64())
            return pa.ListArray.from_arrays(_offsets(lists), known().take(flat))

        def handed_down(own, start=None):
            """Of the nearest ancestor that has one: ``own`` of its name and attributes."""
            values, out = {}, []
            for p in up:
                if p >= 0 and p not in values:
                    mine = own(names[p], attrs[p])
                    values[p] = out[p] if mine is None else mine
                out.append(start if p < 0 else values[p])
            return out

        def holder(read):
            """Of an option, the element it is a choice of."""
            out = [None] * size
            for row, name in enumerate(names):
                if name.upper() == "OPTION":
                    p = up[row]
                    while p >= 0 and names[p].upper() == "OPTGROUP":
                        p = up[p]
                    out[row] = read(p) if p >= 0 else None
            return pa.array(out, pa.string())

        def near_text():
            have = sorted(self.near)
            counts = np.zeros(size + 1, np.int64)
            counts[np.array(have, np.int64) + 1] = [len(self.near[r]) for r in have]
            pieces = list(chain.from_iterable(map(self.near.get, have)))
            return pa.ListArray.from_arrays(
                pa.array(np.cumsum(counts), pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array([d for d, _ in pieces], pa.int32()),
                     pa.array([t for _, t in pieces], pa.string())],
                    names=["d", "t"],
                ),
            )

        make = {
            "snapshot_id": keys, "id": lambda: id_column,
            "parent_id": lambda: id_column.take(pa.array(parents, mask=parents < 0)),
            "node_name": lambda: pa.array(names, pa.string()), "node_type": lambda: pa.array(types, pa.int32()),
            "attributes": lambda: _maps(attrs), "node_value": lambda: pa.array(values, pa.string()),
            "frame_id": lambda: pa.array(frame_ids, pa.string()), "frame_path": lambda: longs(frame_paths),
            "shadow_path": lambda: longs(shadow_paths), "pre": lambda: pa.array(pres, pa.int32()),
            "post": lambda: pa.array(self.post, pa.int32()), "depth": lambda: pa.array(depth, pa.int32()),
            "ancestors": lambda: above(known()), "near_text": near_text, "labelledby": lambda: few(self.labelledby),
            "label_text": lambda: few(self.label_text),
            "compat_forms": lambda: _maps([_compat_forms(m) if m else m for m in attrs]),
            "ancestor_ids": lambda: above(id_column), "containers": containers,
            "in_hidden": lambda: pa.array(handed_down(lambda n, m: hides(n, m) or None, False), pa.bool_()),
            "region_above": lambda: pa.array(handed_down(region_as_ancestor), pa.string()),
            "holder_tag": lambda: holder(lambda p: names[p]),
            "holder_role": lambda: holder(lambda p: role_from_markup(names[p], attrs[p].get("role"))),
            "parent_ax_name": lambda: pa.array([attrs[p].get("aria-label") if p >= 0 else None for p in up], pa.string()),
        }
        columns = [make[name]() for name in schema.names]
        out = pa.RecordBatch.from_arrays(
            [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)],
            schema=schema,
        )
        self.reset()
        return out


_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


def hides(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element keeps itself and what is in it out of the accessibility tree."""
    return name.upper() == "TEMPLATE" or bool(attrs) and (
            "hidden" in attrs
            or "aria-hidden" in attrs and attrs["aria-hidden"].lower() == "true"
            or "style" in attrs and bool(_UNSHOWN.search(attrs["style"])))


def role_from_markup(name: str, role: str | None) -> str | None:
    """Role of an ancestor by its role attribute, else by its tag; the rule of ``tree.derived_role``."""
    explicit = role.strip(" ").split(" ", 1)[0].lower() if role else None
    return explicit or TAG_ROLE.get(name.upper())


def _lower(text: str | None) -> str | None:
    return text.lower() if text else text


def groups(name: str, attrs: dict[str, str]) -> bool:
    """Whether an ancestor is a container; the rule of ``tree.with_grouping`` for derived roles."""
    role = attrs.get("role")
    return (name.upper() in _GROUPING_TAGS or role_from_markup(name, role) in _GROUPING_ROLES
            or _lower(role) in _GROUPING_ROLES)


def region_as_ancestor(name: str, attrs: dict[str, str]) -> str | None:
    """Region that an ancestor stands for; the rule of ``tree.resolve_region`` for derived roles."""
    role, name = attrs.get("role"), name.upper()
    for region in (ROLE_TO_REGION.get(role_from_markup(name, role)), TAG_TO_REGION.get(name), ROLE_TO_REGION.get(_lower(role))):
        if region is not None:
            return region
    return None


def _offsets(rows: list) -> pa.Array:
    return pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())


def _maps(rows: list[dict[str, str]]) -> pa.MapArray:
    return pa.MapArray.from_arrays(
        _offsets(rows), pa.array(list(chain.from_iterable(rows)), pa.string()),
        pa.array([v for m in rows if m for v in m.values()], pa.string()))


def _compat_text(value: str) -> str:
    return (value if value.isascii() else unicodedata.normalize("NFKC", value)).strip()


def _compat_forms(attrs: dict[str, str]) -> dict[str, str]:
    """NFKC forms of the few attribute values that are not in that form already."""
    return {k: n for k, v in attrs.items()
            if not v.isascii() and (n := unicodedata.normalize("NFKC", v)) != v}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        name = name.lower()
        if name not in out:
            value = a or b or c
            out[name] = _html.unescape(value) if "&" in value else value
    return out


_TAG_RULES: dict[str, tuple] = {}  # of the names met, as far as they fit


def _tag_rules(tag: str) -> tuple:
    """What the parser knows of a tag by its name."""
    name = tag.upper()
    known = (name, name in ("HTML", "HEAD", "BODY"), name not in _HEAD_ONLY and name != "HEAD", name in _CLOSES_P,
            name in _HEADINGS, _AUTO_CLOSE.get(name), name in _RAW or name in _RCDATA, name in _VOID)
    if len(_TAG_RULES) < 4096:
        _TAG_RULES[tag] = known
    return known


_PARAGRAPH = frozenset({"P"})


def _read_html(nodes: _NodeBatch, text: str, frame_path: tuple = (), nesting: int = 0) -> None:
    """Feed one HTML document into the batch, closing elements the way browsers do for the common
    omissions.  Formatting elements are not re-opened after a forced close."""
    base = len(nodes._stack)
    node_open, node_close, reads_text, reads_attributes = nodes.open, nodes.close, nodes.reads_text, nodes.reads_attributes
    node_open("#document", 9, frame_path=frame_path)
    names: list[str] = ["#document"]
    shadow: tuple = ()

    def pop_to(depth: int) -> None:
        nonlocal shadow
        while len(names) > depth:
            node_close()
            if names.pop() == "#document-fragment":
                shadow = shadow[:-1]

    def close_open(targets: frozenset, stop: frozenset) -> None:
        found = None
        for i in range(len(names) - 1, 0, -1):
            if names[i] in targets:
                found = i
            elif names[i] in stop:
                break
        if found is not None:
            pop_to(found)

    def add_text(value: str, entities: bool = True) -> None:
        if value and not value.isspace():
            nodes.aside(3, _html.unescape(value) if entities and reads_text and "&" in value else value,
                        frame_path, shadow)

    pos, end = 0, len(text)
    tokens = _TOKEN.finditer(text)
    while pos < end:
        m = next(tokens, None)
        if m is None:
            add_text(text[pos:])
            break
        start = m.start()
        if start > pos:
            add_text(text[pos:start])
        pos = m.end()
        closing, tag, given, tag2, given2 = m.groups()
        if closing:
            name = closing.upper()
            if names[-1] == name:
                pop_to(len(names) - 1)
                continue
            for i in range(len(names) - 1, 0, -1):
                if names[i] == name:
                    pop_to(i)
                    break
                if name == "TEMPLATE" and names[i] == "#document-fragment":
                    pop_to(i)
                    break
                if name in _INLINE and names[i] not in _INLINE:
                    break
                if name not in ("HTML", "BODY", "TABLE") and names[i] in _SCOPE \
                        and names[i] not in ("HTML", "BUTTON"):
                    break
        elif tag or tag2:
            name, once, leaves_head, closes_p, heading, auto_close, raw, void = _TAG_RULES.get(
                tag or tag2) or _tag_rules(tag or tag2)
            given = given or given2
            # A few attributes make a tree of their own, whether or not attributes are read.
            attrs = _attributes(given) if given and (reads_attributes or name == "TEMPLATE" or name == "IFRAME"
                                                     ) else _NO_ATTRIBUTES
            if once and name in names:
                continue
            if leaves_head and "HEAD" in names:
                pop_to(names.index("HEAD"))
            if closes_p and "P" in names:
                close_open(_PARAGRAPH, _SCOPE)
            if heading and names[-1] in _HEADINGS:
                pop_to(len(names) - 1)
            if auto_close:
                close_open(*auto_close)
            if name == "TEMPLATE" and attrs.get("shadowrootmode") in ("open", "closed"):
                shadow += (nodes.rows[nodes._stack[-1][0]][0],)
                node_open("#document-fragment", 11, frame_path=frame_path, shadow_path=shadow)
                names.append("#document-fragment")
                continue
            row = node_open(name, 1, attrs, None, None, None, frame_path, shadow)
            if raw:
                stop = _RAW_END[name].search(text, pos)
                body = text[pos:stop.start()] if stop else text[pos:]
                pos = stop.end() if stop else end
                tokens = _TOKEN.finditer(text, pos)
                if name == "IFRAME":
                    if attrs.get("srcdoc"):
                        _read_html(nodes, attrs["srcdoc"], frame_path + (nodes.rows[row][0],),
                                   nesting + 1)
                else:
                    add_text(body, name in _RCDATA)
                node_close()
            elif void or (m[0].endswith("/>") and ("SVG" in names or "MATH" in names)):
                node_close()
            else:
                names.append(name)
        elif m[0].startswith("<!--"):
            nodes.aside(8, m[0][4:-3] if m[0].endswith("-->") else m[0][4:], frame_path, shadow)
    pop_to(0)
    assert len(nodes._stack) == base


def _read_json(nodes: _NodeBatch, doc: dict) -> None:
    """Feed one capture tree ({root: {...}} or the root itself) into the batch."""
    root = doc.get("root", doc)
    # Explicit stack: documents can be deeper than Python's recursion limit.
    todo: list = [(root, (), ())]
    while todo:
        item = todo.pop()
        if item is None:
            nodes.close()
            continue
        node, frames, shadows = item
        flat = node.get("attributes") or []
        attrs = dict(zip(flat[::2], flat[1::2])) if isinstance(flat, list) else flat
        if isinstance(flat, list) and len(flat) % 2:
            attrs[flat[-1]] = ""
        node_id = node["backendNodeId"]
        nodes.open(node["nodeName"], node["nodeType"], attrs, node.get("nodeValue") or None,
                   node_id=node_id, frame_id=node.get("frameId"), frame_path=frames,
                   shadow_path=shadows)
        later = [(c, frames, shadows) for c in node.get("children") or []]
        later += [(c, frames, shadows + (node_id,)) for c in node.get("shadowRoots") or []]
        if node.get("contentDocument"):
            later.append((node["contentDocument"], frames + (node_id,), ()))
        todo.append(None)
        todo.extend(reversed(later))


def _arrow_schema(key_type: pa.DataType, columns=None) -> pa.Schema:
    anc = pa.struct([("id", pa.int64())] + [
        (n, pa.string()) for n in ("tag", "role", "aria_label", "title", "html_id")]
        + [("hidden", pa.bool_()), ("ax_role", pa.string()), ("ax_name", pa.string())])
    longs = pa.list_(pa.int64())
    whole = pa.schema([
        ("snapshot_id", key_type), ("id", pa.int64()), ("parent_id", pa.int64()),
        ("node_name", pa.string()), ("node_type", pa.int32()),
        ("attributes", pa.map_(pa.string(), pa.string())), ("node_value", pa.string()),
        ("frame_id", pa.string()), ("frame_path", longs), ("shadow_path", longs),
        ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()),
        ("ancestors", pa.list_(anc)),
        ("near_text", pa.list_(pa.struct([("d", pa.int32()), ("t", pa.string())]))),
        ("labelledby", pa.string()), ("label_text", pa.string()),
        ("compat_forms", pa.map_(pa.string(), pa.string())),
    ])
    if columns is None:
        return whole
    digests = [("ancestor_ids", longs), ("in_hidden", pa.bool_()), ("containers", pa.list_(anc)),
               *((n, pa.string()) for n in ("region_above", "holder_tag", "holder_role", "parent_ax_name"))]
    return pa.schema([f for f in [*whole, *pa.schema(digests)] if f.name == "snapshot_id" or f.name in columns])


def _explode_documents(df: DataFrame, key: str, column: str, feed,
                       text_everywhere: bool = False, texts: bool = True, columns=None) -> DataFrame:
    source = df.select(F.col(key).alias("snapshot_id"), F.col(column).alias("doc"))
    key_type = source.schema["snapshot_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _NodeBatch(texts, columns)
        for batch in batches:
            schema = _arrow_schema(batch.schema.field(0).type, columns)
            for k, doc in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = doc.as_py()
                if doc is None:
                    continue
                nodes.start(k, text_everywhere)
                try:
                    feed(nodes, doc)
                except BrokenCapture:
                    nodes.drop()
                    continue
                nodes.finish()
                if len(nodes.rows) >= FLUSH_NODES:
                    yield nodes.batch(schema)
            if nodes.rows:
                yield nodes.batch(schema)

    # Dozens of rows come from one document, which size estimates do not see: they would broadcast the table.
    made = [f"{name} {kind}" for name, kind in (column_list(DOM_COLUMNS) if columns is None else [
        c for c in column_list(f"{DOM_COLUMNS}, {DOM_DIGESTS}") if c[0] in columns])]
    return source.mapInArrow(run, ", ".join([f"snapshot_id {key_type}", *made])).hint("merge")


def html_to_dom(pages: DataFrame, key: str = "page_id", html: str = "html", texts: bool = True, columns=None) -> DataFrame:
    """One row per document node of every page, in browser document order (``pre``). Without ``texts`` text nodes and
    comments get no rows: they keep their places in the order, and elements have their text all the same. That is
    enough to compile elements, and about half of the rows. Only the ``columns`` named are made, for the optimizer does
    not see into the parser; those of ``DOM_COLUMNS`` by default. ``ELEMENT_COLUMNS`` are what elements are compiled from:
    not every ancestor of every node, but what they add up to."""
    return _explode_documents(pages, key, html, _read_html, texts=texts, columns=columns)


def flatten_dom_json(df: DataFrame, column: str, key: str = "snapshot_id") -> DataFrame:
    """The same table from nested capture JSON: light children first, then shadow roots, then the
    frame's document. A broken capture has no rows; ``broken_captures`` lists it."""
    return _explode_documents(df, key, column, _feed_json, text_everywhere=True)


def _feed_json(nodes: _NodeBatch, doc: str) -> None:
    try:
        _read_json(nodes, json.loads(doc))
    except (ValueError, KeyError, TypeError, AttributeError, IndexError) as e:
        raise BrokenCapture(f"{type(e).__name__}: {e}") from e


def broken_captures(df: DataFrame, column: str, key: str = "snapshot_id") -> DataFrame:
    """(key, error) of each capture whose document tree cannot be read: no JSON, or nodes without id, name or type. Null
    is no capture, and no error."""
    source = df.select(key, F.col(column).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _NodeBatch()
        for batch in batches:
            keys, errors = [], []
            for k, doc in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (doc := doc.as_py()) is None:
                    continue
                nodes.reset()
                nodes.start(k)
                try:
                    _feed_json(nodes, doc)
                except BrokenCapture as e:
                    keys.append(k)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(errors, pa.string())], names=[key, "error"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, error string")
