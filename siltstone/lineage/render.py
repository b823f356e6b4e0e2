"""Text, JSON and DOT output."""

from __future__ import annotations

import html
import json
from pathlib import Path

from . import documents
from .naming import QUERY_RESULT

#: What a diagram can be written as; anything but DOT text needs the ``dot`` program.
FORMATS = ("png", "svg", "pdf", "jpg", "jpeg", "dot", "ps")
STYLES = {
    "table": {"shape": "box", "style": "filled", "fillcolor": "#dbe9f6"},
    "view": {"shape": "box", "style": "filled,dashed", "fillcolor": "#dbe9f6"},
    "cte": {"shape": "box", "style": "filled,rounded", "fillcolor": "#e6f2dc"},
    "derived_table": {"shape": "box", "style": "filled,rounded", "fillcolor": "#fbeed5"},
    "query_result": {"shape": "box", "style": "filled,bold", "fillcolor": "#eadcf2"},
    "column": {"shape": "ellipse", "style": "filled", "fillcolor": "#f5f5f5"},
}


def as_json(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def compact(lineage: dict) -> str:
    """A line for each target."""
    if lineage["errors"]:
        return "Error: " + "; ".join(lineage["errors"])
    up = lineage["table_lineage"]["upstream"]
    lines = ["Table Lineage:", *(f"  {t} <- {', '.join(sorted(s)) or 'None'}" for t, s in sorted(up.items()))]
    return "\n".join([*lines, f"Column Lineage: {len(lineage['column_lineage']['upstream'])} columns tracked"])


#: Terminal codes of a coloured report.
COLOURS = {"title": "1", "errors": "31", "warnings": "33", "target": "36", "source": "32"}


def console(lineage: dict, tables: bool = True, columns: bool = True, color: bool = False) -> str:
    """A report: the statement, what is wrong, trees of what each target comes from, and what is done on the way."""
    paint = lambda kind, text: f"\x1b[{COLOURS[kind]}m{text}\x1b[0m" if color else text
    out = [paint("title", f"SQL lineage ({lineage['dialect']})"), " ".join((lineage["sql"] or "").split())[:200]]
    for name in ("errors", "warnings"):
        if lineage[name]:
            out += ["", paint("title", name.capitalize()), *(paint(name, f"  {x}") for x in lineage[name])]
    for name, wanted in (("table_lineage", tables), ("column_lineage", columns)):
        if wanted and lineage[name]["upstream"]:
            out += ["", paint("title", name.replace("_", " ").capitalize())]
            for target, sources in sorted(lineage[name]["upstream"].items()):
                out += [paint("target", f"  {target}"), *(paint("source", f"    <- {s}") for s in sorted(sources))]
                for step in dict.fromkeys(x for t in lineage[name]["transformations"].get(target, []) for x in done(t)):
                    out.append(f"       {step}")
    if tables and lineage["metadata"]:
        out += ["", paint("title", "Metadata"), *(f"  {n}: {m['table_type']}, {m['description']}, {len(m.get('columns') or [])} columns" for n, m in sorted(lineage["metadata"].items()))]
    return "\n".join(out)


def done(t: dict) -> list[str]:
    """What a table transformation does, a line each; of a column's there is nothing but its expression."""
    if "source_table" not in t:
        return []
    out = [f"{j['join_type']} {j['right_table']}" + "".join(f" {'ON' if k == 0 else 'AND'} {c['left_column']} {c['operator']} {c['right_column']}" for k, c in enumerate(j["conditions"])) for j in t["joins"]]
    for key, word in (("filter_conditions", "WHERE"), ("having_conditions", "HAVING")):
        out += [" ".join(x for x in (word, c["column"], c["operator"], c["value"]) if x) for c in t[key]]
    out += [f"{word} {', '.join(t[key])}" for key, word in (("group_by_columns", "GROUP BY"), ("order_by_columns", "ORDER BY")) if t[key]]
    return out


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _attributes(values: dict) -> str:
    return "[" + ", ".join(f"{k}={_quoted(str(v))}" for k, v in values.items()) + "]"


def direction(chain_type: str, layout: str = "horizontal") -> str:
    """Sources are drawn first: to the left or on top."""
    up = chain_type == "upstream"
    return ("RL" if up else "LR") if layout == "horizontal" else ("BT" if up else "TB")


def edge_label(steps: list[dict]) -> str:
    """What happens along an edge, in a few words."""
    parts: list[str] = []
    for t in steps:
        for j in t.get("joins", []):
            on = " AND ".join(f"{c['left_column']} {c['operator']} {c['right_column']}" for c in j["conditions"])
            parts.append(f"{j['join_type']}{f' ON {on}' if on else ''}")
        for key, word in (("filter_conditions", "WHERE"), ("group_by_columns", "GROUP BY"), ("having_conditions", "HAVING"), ("order_by_columns", "ORDER BY")):
            if t.get(key):
                parts.append(f"{word} ({len(t[key])})")
        parts += [u["union_type"] for u in t.get("unions", [])]
    return "\n".join(dict.fromkeys(parts))


def chain_dot(document: dict | str, layout: str = "horizontal", show_columns: bool = True, styles: dict | None = None) -> str:
    """DOT text of a comprehensive chain: each entity once, edges labelled by what they do."""
    doc = check(document)
    looks = {k: STYLES.get(k, {}) | (styles or {}).get(k, {}) for k in {*STYLES, *(styles or {})}}
    lines = ["digraph lineage {", f"  rankdir={direction(doc['chain_type'], layout)};", '  node [fontname="Helvetica", fontsize=10];']
    nodes, edges = {}, {}
    for n in documents.walk(doc["chains"]):
        nodes.setdefault(n["entity"], n)
        for d in n["dependencies"]:
            edges.setdefault((n["entity"], d["entity"]), []).extend(d.get("transformations", []))
    for name, n in nodes.items():
        label = name
        if show_columns and n["metadata"].get("table_columns"):
            label += "\n" + "\n".join(f"{c['name']} ({c['type']})" for c in n["metadata"]["table_columns"])
        lines.append(f"  {_quoted(name)} {_attributes(looks.get(n['entity_type'], {}) | {'label': label})};")
    lines += [f"  {_quoted(a)} -> {_quoted(b)}" + (f" [label={_quoted(text)}]" if (text := edge_label(steps)) else "") + ";" for (a, b), steps in edges.items()]
    return "\n".join([*lines, "}"])


def step_lines(t: dict) -> list[str]:
    """All that a transformation does, a line each."""
    out = []
    for j in t.get("joins", []):
        on = " AND ".join(f"{c['left_column']} {c['operator']} {c['right_column']}" for c in j["conditions"])
        out.append(f"{j['join_type']} {j['right_table']}" + (f" ON {on}" if on else ""))
    for key, word in (("filter_conditions", "WHERE"), ("having_conditions", "HAVING")):
        for c in t.get(key, []):
            value = f"({', '.join(c['value'])})" if isinstance(c["value"], list) else c["value"] or ""
            out.append(" ".join(x for x in (word, c["column"], c["operator"], value) if x))
    for key, word in (("group_by_columns", "GROUP BY"), ("order_by_columns", "ORDER BY")):
        if t.get(key):
            out.append(f"{word} {', '.join(t[key])}")
    if limit := t.get("limiting"):
        out.append(" ".join(f"{k.upper()} {v}" for k, v in limit.items() if v))
    return [*out, *(u["union_type"] for u in t.get("unions", []))]


def _table(name: str, kind: str, columns: list[dict], looks: dict) -> str:
    """An entity as a table with a port for each column; the result of a statement has a double frame."""
    fill, frame = looks.get(kind, {}).get("fillcolor", "#ffffff"), 2 if name == QUERY_RESULT else 1
    rows = [f'<TR><TD BGCOLOR="{fill}" PORT="name"><B>{html.escape(name)}</B></TD></TR>']
    for k, c in enumerate(columns):
        made = c.get("transformation", {}).get("source_expression")
        text = html.escape(c["name"]) + (f" <I>{html.escape(_short(made))}</I>" if made else "")
        rows.append(f'<TR><TD ALIGN="LEFT" PORT="c{k}">{text}</TD></TR>')
    return f'<<TABLE BORDER="{frame}" CELLBORDER="1" CELLSPACING="0">{"".join(rows)}</TABLE>>'


def _short(text: str, most: int = 40) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def detailed_dot(document: dict | str, layout: str = "horizontal", styles: dict | None = None) -> str:
    """DOT text of a comprehensive chain: tables with column ports, a box for what is done between two of them, and lines between columns."""
    doc = check(document)
    looks = {k: STYLES.get(k, {}) | (styles or {}).get(k, {}) for k in {*STYLES, *(styles or {})}}
    nodes, steps = {}, {}
    for n in documents.walk(doc["chains"]):
        if not n.get("repeated"):
            nodes.setdefault(n["entity"], n)
        for d in n["dependencies"]:
            own = steps.setdefault((n["entity"], d["entity"]), [])
            own += [x for t in d.get("transformations", []) for x in step_lines(t) if x not in own]
    lines = ["digraph lineage {", f"  rankdir={direction(doc['chain_type'], layout)};", '  node [fontname="Helvetica", fontsize=10, shape=plain];']
    ports: dict[str, str] = {}
    for name, n in nodes.items():
        columns = n["metadata"].get("table_columns") or []
        lines.append(f"  {_quoted(name)} [label={_table(name, n['entity_type'], columns, looks)}];")
        ports |= {documents.dotted(name, c["name"]): f"{_quoted(name)}:c{k}" for k, c in enumerate(columns)}
    for k, ((a, b), texts) in enumerate(steps.items()):
        if texts:
            box = f'"step {k}"'
            lines.append(f"  {box} [shape=note, style=filled, fillcolor={_quoted('#fff8c5')}, label={_quoted(chr(10).join(texts))}];")
            lines += [f"  {_quoted(a)}:name -> {box};", f"  {box} -> {_quoted(b)}:name;"]
        else:
            lines.append(f"  {_quoted(a)}:name -> {_quoted(b)}:name;")
    up = doc["chain_type"] == "upstream"
    for name, n in nodes.items():
        for c in n["metadata"].get("table_columns") or []:
            for origin in c["upstream"]:
                if origin in ports:
                    ends = (ports[documents.dotted(name, c["name"])], ports[origin])
                    lines.append(f"  {ends[not up]} -> {ends[up]} [style=dashed, color={_quoted('#888888')}];")
    return "\n".join([*lines, "}"])


def simple_dot(document: dict | str, layout: str = "horizontal") -> str:
    """DOT text of a table chain or a column chain."""
    doc = check(document)
    lines, seen = ["digraph lineage {", f"  rankdir={direction(doc['chain_type'], layout)};"], set()

    def add(n: dict) -> None:
        kind = "table" if "table" in n else "column"
        if n[kind] not in seen:
            seen.add(n[kind])
            lines.append(f"  {_quoted(n[kind])} {_attributes(STYLES[kind])};")
        for d in n["dependencies"]:
            add(d)
            line = f"  {_quoted(n[kind])} -> {_quoted(d[kind])};"
            if line not in seen:
                seen.add(line)
                lines.append(line)

    for n in doc["chains"].values():
        add(n)
    return "\n".join([*lines, "}"])


def check(document: dict | str) -> dict:
    """The document, if it has what a diagram needs."""
    doc = json.loads(document) if isinstance(document, str) else document
    missing = [k for k in ("chains", "chain_type") if k not in doc]
    if missing:
        raise ValueError(f"not a chain document: {', '.join(missing)} missing")
    return doc


def write_diagram(dot: str, path: str, kind: str = "dot") -> str:
    """Writes DOT text, or what the ``dot`` program makes of it where there is one; the file's name."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind}; supported: {', '.join(FORMATS)}")
    target = Path(path).with_suffix(f".{kind}")
    if kind == "dot":
        target.write_text(dot, encoding="utf-8")
        return str(target)
    import shutil
    import subprocess

    if not shutil.which("dot"):
        raise RuntimeError("the dot program is not installed; write DOT text instead")
    subprocess.run(["dot", f"-T{kind}", "-o", str(target)], input=dot.encode(), check=True, timeout=120)
    return str(target)
