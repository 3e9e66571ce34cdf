"""The tables of program facts and records, and their schemas."""

from __future__ import annotations

#: Name to DDL.
SCHEMAS = {
    "path_element": "path string, root string, origin string, data binary",
    "app": "name string, main_class string, main_method string, app_packages array<string>",
    "class_file": "name string, origin string, data binary, seq long",
    "class": "name string, super_name string, interfaces array<string>, access int, source_file string, origin string",
    "field": "class string, name string, descriptor string, access int, is_static boolean",
    "method": "method_id string, class string, name string, descriptor string, subsig string, access int, is_static boolean, is_native boolean, is_abstract boolean",
    "stmt": "method string, idx int, kind string, text string, line int, targets array<int>, default_target int",
    "call": "method string, idx int, class string, subsig string, kind string",
    "trap": "method string, ord int, begin_idx int, end_idx int, handler_idx int, exception string",
    "expr": "method string, idx int, expr_id int, parent_id int, pos int, side string, kind string, text string, type string, callee string, field string",
    "state": "id long, kind string, method string, stmt_index int, stmt_kind string, stmt_text string, fp string, kont string, seq long",
    "state_edge": "id long, src long, dst long",
    "node_tag": "id long, node long, tag string, type string",
    "loop_node": "id long, kind string, method string, stmt_index int, loop_kind string, loop_args map<string,string>",
    "loop_edge": "src long, dst long, is_recursion boolean",
    "taint_node": "addr_id string, kind string, class string, method string, stmt_index int, payload string, idx int",
    "taint_edge": "src string, dst string, rel string, rel_idx int",
    "snap_static_field": "class string, field string, type string, value string",
    "snap_instance_field": "object long, class string, field string, type string, value string",
    "snap_array_element": "array long, type string, index int, element string",
}


def shape(name: str) -> list[tuple[str, str]]:
    """The columns of a table with their types' short names."""
    short = {"long": "bigint"}
    return [(c, short.get(t, t)) for c, t in (part.split(" ", 1) for part in SCHEMAS[name].split(", "))]
