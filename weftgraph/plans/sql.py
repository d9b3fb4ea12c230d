"""Reference SQL (DuckDB dialect) of the graph tables, as common table expressions shared by the checks."""

from __future__ import annotations

from weftgraph.plans.queries import NEVER_DEAD
from weftgraph.schema import EDGE_LABELS

_LABELS = ", ".join(f"('{t}', '{s}', '{d.split('|')[0]}')" for t, (s, d) in EDGE_LABELS.items())
_DEAD = ", ".join(f"'{n}'" for n in NEVER_DEAD)

CTES: dict[str, tuple[str, list[str]]] = {
    "repos": ("SELECT repo_id, name, path, description, last_indexed FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY last_indexed DESC NULLS LAST, description NULLS LAST) rn FROM repositories) WHERE rn = 1", []),
    "files": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY scanned_at DESC NULLS LAST, scan_id DESC) rn FROM code_files) WHERE rn = 1 AND NOT coalesce(is_deleted, false)", []),
    "classes": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY parsed_at DESC NULLS LAST, deleted_at DESC NULLS LAST) rn FROM code_classes) WHERE rn = 1 AND deleted_at IS NULL", []),
    "funcs": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY parsed_at DESC NULLS LAST, deleted_at DESC NULLS LAST) rn FROM code_functions) WHERE rn = 1 AND deleted_at IS NULL", []),
    "labels": (f"SELECT * FROM (VALUES {_LABELS}) t(rel_type, sl, dl)", []),
    "known": ("SELECT 'Repository' l, repo_id, repo_id id FROM repos UNION ALL SELECT 'File', repo_id, path FROM files UNION ALL SELECT 'Class', repo_id, id FROM classes UNION ALL SELECT 'Function', repo_id, id FROM funcs", ["repos", "files", "classes", "funcs"]),
    "rels": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rel_type, source_id, target_id ORDER BY created_at DESC NULLS LAST, rel_id DESC) rn FROM code_relationships) WHERE rn = 1", []),
    "edges": ("SELECT e.repo_id, e.rel_type, e.source_id src, e.target_id dst, e.rel_id FROM rels e JOIN labels USING (rel_type) JOIN known a ON a.l = sl AND a.repo_id = e.repo_id AND a.id = e.source_id JOIN known b ON b.l = dl AND b.repo_id = e.repo_id AND b.id = e.target_id", ["rels", "labels", "known"]),
    "contained": ("SELECT repo_id, dst file_id FROM edges WHERE rel_type = 'CONTAINS_FILE'", ["edges"]),
    "scope0": ("SELECT e.repo_id, e.src file_id, e.dst id FROM edges e WHERE rel_type = 'DEFINES_FUNCTION' UNION ALL SELECT a.repo_id, a.src, b.dst FROM edges a JOIN edges b ON a.repo_id = b.repo_id AND a.dst = b.src WHERE a.rel_type = 'DEFINES_CLASS' AND b.rel_type = 'HAS_METHOD'", ["edges"]),
    "scope": ("SELECT s.repo_id, s.file_id, s.id FROM scope0 s SEMI JOIN contained c ON s.repo_id = c.repo_id AND s.file_id = c.file_id", ["scope0", "contained"]),
    "where_": ("SELECT repo_id, id, min(file_id) fp FROM scope GROUP BY 1, 2", ["scope"]),
    "tops": ("SELECT repo_id, dst id, min(src) fp FROM edges WHERE rel_type = 'DEFINES_FUNCTION' GROUP BY 1, 2", ["edges"]),
    "cfile": ("SELECT repo_id, dst id, min(src) fp FROM edges WHERE rel_type = 'DEFINES_CLASS' GROUP BY 1, 2", ["edges"]),
    "owner": ("SELECT e.repo_id, e.dst id, min(c.name) cn FROM edges e JOIN classes c ON c.repo_id = e.repo_id AND c.id = e.src WHERE rel_type = 'HAS_METHOD' GROUP BY 1, 2", ["edges", "classes"]),
    "refs": ("SELECT rel_id, repo_id, CASE WHEN sl = 'Repository' THEN source_id ELSE repo_id END key_repo, 'source' side, sl l, source_id id, rel_type, created_at FROM code_relationships JOIN labels USING (rel_type) UNION ALL SELECT rel_id, repo_id, repo_id, 'target', dl, target_id, rel_type, created_at FROM code_relationships JOIN labels USING (rel_type)", ["labels"]),
    "plinks": ("SELECT c.repo_id, c.id child, k.id parent, min(c.ord) ord FROM (SELECT repo_id, id, ord, regexp_extract(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(e, '<[^<>]*>|\\[[^\\[\\]]*\\]', '', 'g'), '<[^<>]*>|\\[[^\\[\\]]*\\]', '', 'g'), '[<\\[(].*$', ''), '[*&]', ' ', 'g')), '([^\\s.:]+)$', 1) bare FROM (SELECT repo_id, id, unnest(list_concat(coalesce(base_classes, []), coalesce(interfaces, []))) e, unnest(range(len(list_concat(coalesce(base_classes, []), coalesce(interfaces, []))))) ord FROM classes)) c JOIN classes k ON k.repo_id = c.repo_id AND k.name = c.bare AND c.bare <> '' GROUP BY ALL", ["classes"]),
    "calls": ("SELECT repo_id, src, dst FROM edges WHERE rel_type = 'CALLS'", ["edges"]),
    "seeds": ("SELECT repo_id, id FROM funcs", ["funcs"]),
}


def with_(names: list[str], body: str, recursive: str = "") -> str:
    """``body`` behind the expressions it needs, in dependency order; ``recursive`` is a further one put last."""
    need: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][1]:
            add(dep)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in need] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def _list(expr: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {expr})), ','), '')"


def _cycles(rel: str) -> str:
    walk = (
        "walk AS (SELECT e.repo_id, e.src start, e.dst here, [e.src, e.dst] cyc, [e.src || '>' || e.dst] used FROM ce e "
        "UNION ALL SELECT w.repo_id, w.start, e.dst, list_append(w.cyc, e.dst), list_append(w.used, e.src || '>' || e.dst) FROM walk w JOIN ce e ON e.repo_id = w.repo_id AND e.src = w.here "
        "WHERE NOT list_contains(w.used, e.src || '>' || e.dst) AND len(w.used) < 5)"
    )
    return with_(["edges"], "SELECT DISTINCT repo_id, array_to_string(cyc, ' > ') AS cycle, CAST(len(used) AS INTEGER) AS cycle_length FROM walk WHERE here = start AND len(used) >= 2", f"ce AS (SELECT DISTINCT repo_id, src, dst FROM edges WHERE rel_type = '{rel}'), {walk}")


_TEST = "({0} LIKE '%/test%' OR contains({0}, 'test_') OR ends_with({0}, '_test.py'))"
_FN = "f.repo_id, f.id, f.name"
_W = "w.repo_id = f.repo_id AND w.id = f.id"

ORACLE: dict[str, str] = {
    "function_by_name": with_(["funcs", "where_", "owner"], f"SELECT {_FN}, f.signature, f.docstring, f.start_line AS \"startLine\", w.fp AS \"filePath\", o.cn AS \"className\" FROM funcs f JOIN where_ w ON {_W} LEFT JOIN owner o ON o.repo_id = f.repo_id AND o.id = f.id"),
    "class_by_name": with_(["classes", "cfile", "edges", "funcs"], f"SELECT c.repo_id, c.id, c.name, c.docstring, c.start_line AS \"startLine\", x.fp AS \"filePath\", coalesce(p.v, '') AS \"parentClasses\", coalesce(m.v, '') AS methods FROM classes c LEFT JOIN cfile x ON x.repo_id = c.repo_id AND x.id = c.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.name')} v FROM edges e JOIN classes k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'EXTENDS' GROUP BY 1, 2) p ON p.repo_id = c.repo_id AND p.id = c.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.name')} v FROM edges e JOIN funcs k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'HAS_METHOD' GROUP BY 1, 2) m ON m.repo_id = c.repo_id AND m.id = c.id"),
    "call_graph": with_(["calls", "seeds", "funcs"], "SELECT DISTINCT d.repo_id, d.source_id, d.callee_id, f.name AS callee_name, CAST(d.depth AS INTEGER) AS depth FROM (SELECT s.repo_id, s.id source_id, a.dst callee_id, 1 depth FROM seeds s JOIN calls a ON a.repo_id = s.repo_id AND a.src = s.id UNION SELECT s.repo_id, s.id, b.dst, 2 FROM seeds s JOIN calls a ON a.repo_id = s.repo_id AND a.src = s.id JOIN calls b ON b.repo_id = s.repo_id AND b.src = a.dst AND NOT (b.src = a.src AND b.dst = a.dst)) d JOIN funcs f ON f.repo_id = d.repo_id AND f.id = d.callee_id"),
    "callers": with_(["calls", "funcs", "where_"], f"SELECT c.repo_id, c.dst AS function_id, f.id, f.name, f.signature, w.fp AS \"filePath\", f.start_line AS \"startLine\" FROM calls c JOIN funcs f ON f.repo_id = c.repo_id AND f.id = c.src LEFT JOIN where_ w ON {_W}"),
    "impact": with_(["calls", "seeds", "funcs", "where_"], f"SELECT r.repo_id, r.start AS function_id, f.id, f.name, w.fp AS \"filePath\", f.start_line AS \"startLine\", CAST(min(r.d) AS INTEGER) AS distance FROM reach r JOIN funcs f ON f.repo_id = r.repo_id AND f.id = r.here LEFT JOIN where_ w ON {_W} WHERE r.d > 0 AND r.here <> r.start GROUP BY ALL", "reach AS (SELECT repo_id, id start, id here, 0 d FROM seeds UNION SELECT r.repo_id, r.start, c.dst, r.d + 1 FROM reach r JOIN calls c ON c.repo_id = r.repo_id AND c.src = r.here WHERE r.d < 3)"),
    "cycles": _cycles("CALLS"),
    "dep_cycles": _cycles("DEPENDS_ON"),
    "class_hierarchy": with_(["classes", "edges"], f"SELECT c.repo_id, c.id, c.name, coalesce(a.v, '') AS ancestors, coalesce(d.v, '') AS descendants FROM classes c LEFT JOIN (SELECT up.repo_id, node id, {_list('k.name')} v FROM up JOIN classes k ON k.repo_id = up.repo_id AND k.id = anc GROUP BY 1, 2) a ON a.repo_id = c.repo_id AND a.id = c.id LEFT JOIN (SELECT up.repo_id, anc id, {_list('k.name')} v FROM up JOIN classes k ON k.repo_id = up.repo_id AND k.id = node GROUP BY 1, 2) d ON d.repo_id = c.repo_id AND d.id = c.id", "up AS (SELECT repo_id, src node, dst anc FROM edges WHERE rel_type = 'EXTENDS' UNION SELECT u.repo_id, u.node, e.dst FROM up u JOIN edges e ON e.repo_id = u.repo_id AND e.src = u.anc WHERE e.rel_type = 'EXTENDS')"),
    "file_deps": with_(["files", "edges"], f"SELECT f.repo_id, f.path AS \"filePath\", coalesce(a.v, '') AS \"dependsOn\", coalesce(b.v, '') AS \"dependedBy\" FROM files f LEFT JOIN (SELECT repo_id, src p, {_list('dst')} v FROM edges WHERE rel_type = 'DEPENDS_ON' GROUP BY 1, 2) a ON a.repo_id = f.repo_id AND a.p = f.path LEFT JOIN (SELECT repo_id, dst p, {_list('src')} v FROM edges WHERE rel_type = 'DEPENDS_ON' GROUP BY 1, 2) b ON b.repo_id = f.repo_id AND b.p = f.path"),
    "similar_functions": with_(["edges", "seeds", "funcs"], "SELECT m.repo_id, m.id AS function_id, f.id, f.name, f.signature, count(*) FILTER (u.rel_type = 'CALLS') AS \"commonCalls\", count(*) FILTER (u.rel_type = 'USES_CLASS') AS \"commonClasses\", CAST(count(*) AS DOUBLE) / any_value(m.n) AS similarity FROM (SELECT s.repo_id, s.id, e.rel_type, e.dst, count(*) OVER (PARTITION BY s.repo_id, s.id) n FROM seeds s JOIN edges e ON e.repo_id = s.repo_id AND e.src = s.id WHERE e.rel_type IN ('CALLS', 'USES_CLASS')) m JOIN edges u ON u.repo_id = m.repo_id AND u.rel_type = m.rel_type AND u.dst = m.dst AND u.src <> m.id JOIN funcs f ON f.repo_id = u.repo_id AND f.id = u.src GROUP BY 1, 2, 3, 4, 5"),
    "code_context": with_(["funcs", "classes", "edges", "where_", "owner", "cfile"], f"SELECT 'function' AS type, f.repo_id, f.id, f.name, f.signature, f.docstring, f.start_line AS \"startLine\", f.end_line AS \"endLine\", w.fp AS \"filePath\", o.cn AS \"className\", coalesce(a.v, '') AS calls, coalesce(b.v, '') AS \"calledBy\", coalesce(u.v, '') AS \"usesClasses\" FROM funcs f LEFT JOIN where_ w ON {_W} LEFT JOIN owner o ON o.repo_id = f.repo_id AND o.id = f.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.id || chr(61) || k.name')} v FROM edges e JOIN funcs k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'CALLS' GROUP BY 1, 2) a ON a.repo_id = f.repo_id AND a.id = f.id LEFT JOIN (SELECT e.repo_id, e.dst id, {_list('k.id || chr(61) || k.name')} v FROM edges e JOIN funcs k ON k.repo_id = e.repo_id AND k.id = e.src WHERE rel_type = 'CALLS' GROUP BY 1, 2) b ON b.repo_id = f.repo_id AND b.id = f.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.name')} v FROM edges e JOIN classes k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'USES_CLASS' GROUP BY 1, 2) u ON u.repo_id = f.repo_id AND u.id = f.id UNION ALL SELECT 'class', c.repo_id, c.id, c.name, NULL, c.docstring, c.start_line, c.end_line, x.fp, NULL, coalesce(m.v, ''), coalesce(p.v, ''), '' FROM classes c LEFT JOIN cfile x ON x.repo_id = c.repo_id AND x.id = c.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.id || chr(61) || k.name')} v FROM edges e JOIN funcs k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'HAS_METHOD' GROUP BY 1, 2) m ON m.repo_id = c.repo_id AND m.id = c.id LEFT JOIN (SELECT e.repo_id, e.src id, {_list('k.name')} v FROM edges e JOIN classes k ON k.repo_id = e.repo_id AND k.id = e.dst WHERE rel_type = 'EXTENDS' GROUP BY 1, 2) p ON p.repo_id = c.repo_id AND p.id = c.id"),
    "search_substring": with_(["funcs", "classes", "files", "where_", "cfile"], f"SELECT f.repo_id, 'function' AS type, f.id, f.name, f.docstring AS description, w.fp AS location, f.start_line AS \"startLine\", CAST(0 AS INTEGER) AS branch FROM funcs f LEFT JOIN where_ w ON {_W} WHERE contains(f.name, 'merge') OR contains(f.docstring, 'merge') OR contains(f.signature, 'merge') UNION ALL SELECT c.repo_id, 'class', c.id, c.name, c.docstring, x.fp, c.start_line, 1 FROM classes c LEFT JOIN cfile x ON x.repo_id = c.repo_id AND x.id = c.id WHERE contains(c.name, 'merge') OR contains(c.docstring, 'merge') UNION ALL SELECT repo_id, 'file', path, name, path, path, 0, 2 FROM files WHERE contains(name, 'merge') OR contains(path, 'merge')"),
    "file_search": with_(["files"], "SELECT repo_id, path AS id, name, path, lines_of_code AS lines FROM files WHERE contains(name, 'handler') OR contains(path, 'handler')"),
    "list_repositories": with_(["repos", "contained", "where_", "cfile", "edges"], "SELECT r.repo_id AS id, r.path, coalesce(a.n, 0) AS \"fileCount\", coalesce(b.n, 0) AS \"functionCount\", coalesce(c.n, 0) AS \"classCount\" FROM repos r LEFT JOIN (SELECT repo_id, count(*) n FROM contained GROUP BY 1) a USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) n FROM where_ GROUP BY 1) b USING (repo_id) LEFT JOIN (SELECT e.repo_id, count(DISTINCT dst) n FROM edges e JOIN contained k ON k.repo_id = e.repo_id AND k.file_id = e.src WHERE rel_type = 'DEFINES_CLASS' GROUP BY 1) c USING (repo_id)"),
    "graph_stats": with_(["repos", "contained", "where_", "edges", "files"], "SELECT r.repo_id, r.name, r.last_indexed AS \"lastIndexed\", coalesce(a.n, 0) AS files, coalesce(m.n, 0) AS modules, coalesce(c.n, 0) AS classes, coalesce(b.n, 0) AS functions, CAST(0 AS BIGINT) AS imports, coalesce(x.n, 0) AS relationships FROM repos r LEFT JOIN (SELECT repo_id, count(*) n FROM contained GROUP BY 1) a USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) n FROM where_ GROUP BY 1) b USING (repo_id) LEFT JOIN (SELECT e.repo_id, count(DISTINCT dst) n FROM edges e JOIN contained k ON k.repo_id = e.repo_id AND k.file_id = e.src WHERE rel_type = 'DEFINES_CLASS' GROUP BY 1) c USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) n FROM edges GROUP BY 1) x USING (repo_id) LEFT JOIN (SELECT repo_id, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) n FROM files WHERE contains(path, '/') GROUP BY 1) m USING (repo_id)"),
    "label_counts": with_(["known", "edges"], "SELECT 'node' AS kind, l AS label, count(*) AS n FROM known GROUP BY 2 UNION ALL SELECT 'node', 'Module', count(*) FROM (SELECT DISTINCT repo_id, regexp_replace(path, '/?[^/]*$', '') FROM files WHERE contains(path, '/')) UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2"),
    "dead_code": with_(["funcs", "calls", "where_"], f"SELECT {_FN}, w.fp AS \"filePath\", f.start_line AS \"startLine\", f.complexity FROM funcs f JOIN where_ w ON {_W} WHERE NOT starts_with(f.name, 'test') AND NOT starts_with(f.name, 'Test') AND f.name NOT IN ({_DEAD}) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.repo_id = f.repo_id AND c.dst = f.id)"),
    "dead_code_global": with_(["funcs", "calls", "where_"], f"SELECT {_FN}, w.fp AS \"filePath\", f.start_line AS \"startLine\", f.complexity FROM funcs f LEFT JOIN where_ w ON {_W} WHERE NOT starts_with(f.name, 'test') AND NOT starts_with(f.name, 'Test') AND f.name NOT IN ({_DEAD}) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.repo_id = f.repo_id AND c.dst = f.id)"),
    "entry_points": with_(["funcs", "calls", "tops"], f"SELECT {_FN}, f.signature, w.fp AS \"filePath\" FROM funcs f JOIN tops w ON {_W} WHERE NOT starts_with(f.name, '_') AND NOT {_TEST.format('w.fp')} AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.repo_id = f.repo_id AND c.dst = f.id)"),
    "entry_points_global": with_(["funcs", "calls", "tops"], f"SELECT {_FN}, f.signature, w.fp AS \"filePath\" FROM funcs f LEFT JOIN tops w ON {_W} WHERE NOT starts_with(f.name, '_') AND (w.fp IS NULL OR NOT {_TEST.format('w.fp')}) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.repo_id = f.repo_id AND c.dst = f.id)"),
    "high_complexity": with_(["funcs", "tops"], f"SELECT {_FN}, f.complexity, f.signature, w.fp AS \"filePath\" FROM funcs f JOIN tops w ON {_W} WHERE f.complexity >= 5"),
    "high_complexity_global": with_(["funcs", "tops"], f"SELECT {_FN}, f.complexity, f.signature, w.fp AS \"filePath\" FROM funcs f LEFT JOIN tops w ON {_W} WHERE f.complexity >= 5"),
    "hotspots": with_(["funcs", "calls", "where_"], f"SELECT {_FN}, w.fp AS \"filePath\", f.complexity, coalesce(o.n, 0) AS \"outgoingCalls\", greatest(coalesce(i.n, 0), 1) AS \"incomingCalls\", coalesce(o.n, 0) + greatest(coalesce(i.n, 0), 1) AS \"totalCoupling\" FROM funcs f JOIN where_ w ON {_W} LEFT JOIN (SELECT repo_id, src id, count(*) n FROM calls GROUP BY 1, 2) o ON o.repo_id = f.repo_id AND o.id = f.id LEFT JOIN (SELECT repo_id, dst id, count(*) n FROM calls GROUP BY 1, 2) i ON i.repo_id = f.repo_id AND i.id = f.id"),
    "tests_for_function": with_(["edges", "funcs", "where_"], f"SELECT e.repo_id, e.dst AS function_id, f.id, f.name, f.signature, w.fp AS \"filePath\", f.start_line AS \"startLine\" FROM edges e JOIN funcs f ON f.repo_id = e.repo_id AND f.id = e.src LEFT JOIN where_ w ON {_W} WHERE e.rel_type = 'TESTS'"),
    "tests_link": with_(["scope", "funcs"], f"SELECT DISTINCT t.repo_id, t.id AS src_id, i.id AS dst_id FROM (SELECT s.repo_id, s.id, CASE WHEN starts_with(f.name, 'test_') THEN substr(f.name, 6) ELSE substr(f.name, 5) END nm FROM scope s JOIN funcs f ON f.repo_id = s.repo_id AND f.id = s.id WHERE starts_with(f.name, 'test') AND {_TEST.format('s.file_id')}) t JOIN (SELECT s.repo_id, s.id, f.name nm FROM scope s JOIN funcs f ON f.repo_id = s.repo_id AND f.id = s.id WHERE NOT {_TEST.format('s.file_id')}) i ON i.repo_id = t.repo_id AND i.nm = t.nm WHERE t.nm <> '' AND i.id <> t.id"),
    "orphans": with_(["funcs", "classes", "edges"], "SELECT 'Function' AS label, repo_id, id, name FROM funcs f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = f.repo_id AND e.dst = f.id AND e.rel_type IN ('DEFINES_FUNCTION', 'HAS_METHOD')) UNION ALL SELECT 'Class', repo_id, id, name FROM classes c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = c.repo_id AND e.dst = c.id AND e.rel_type = 'DEFINES_CLASS')"),
    "integrity": with_(["funcs", "classes"], "SELECT DISTINCT repo_id, source_id AS source, rel_type AS rel, target_id AS target_node_id FROM code_relationships r WHERE (rel_type = 'CALLS' AND NOT EXISTS (SELECT 1 FROM funcs f WHERE f.repo_id = r.repo_id AND f.id = r.target_id)) OR (rel_type = 'EXTENDS' AND NOT EXISTS (SELECT 1 FROM classes f WHERE f.repo_id = r.repo_id AND f.id = r.target_id))"),
    "language_histogram": with_(["classes"], "SELECT language_type, count(*) AS n FROM classes GROUP BY 1"),
    "classes_many_methods": with_(["classes", "edges"], "SELECT c.repo_id, c.id, c.name, count(*) AS methods FROM classes c JOIN edges e ON e.repo_id = c.repo_id AND e.src = c.id WHERE e.rel_type = 'HAS_METHOD' GROUP BY 1, 2, 3 HAVING count(*) > 2"),
    "implementations": with_(["classes", "edges"], "SELECT e.repo_id, a.id, a.name, b.id AS interface_id, b.name AS interface FROM edges e JOIN classes a ON a.repo_id = e.repo_id AND a.id = e.src JOIN classes b ON b.repo_id = e.repo_id AND b.id = e.dst WHERE e.rel_type = 'IMPLEMENTS'"),
    "staleness": with_(["repos"], "SELECT repo_id, last_indexed, round((epoch(TIMESTAMP '2025-07-01 00:00:00') - floor(epoch(last_indexed))) / 3600.0, 6) AS age_hours, coalesce((epoch(TIMESTAMP '2025-07-01 00:00:00') - floor(epoch(last_indexed))) / 3600.0 > 24, true) AS stale FROM repos"),
    "resources": with_(["repos"], "SELECT 'repository://' || repo_id AS uri, name, coalesce(description, '') AS description FROM repos"),
    "edge_upsert": with_(["edges"], "SELECT repo_id, rel_type, src AS src_id, dst AS dst_id, rel_id FROM edges"),
    "merge_last_wins": with_(["funcs"], "SELECT repo_id, id, name, signature, complexity FROM funcs"),
    "modules": with_(["files"], "SELECT DISTINCT repo_id, regexp_replace(path, '/?[^/]*$', '') AS path, replace(regexp_replace(path, '/?[^/]*$', ''), '/', '.') AS id, list_extract(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), -1) AS name, 'package' AS module_type FROM files WHERE contains(path, '/')"),
    "resolve_extends": with_(["classes"], "SELECT DISTINCT b.repo_id, b.id AS src_id, k.id AS dst_id FROM (SELECT repo_id, id, unnest(base_classes) n FROM classes) b JOIN (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path DESC, start_line DESC NULLS LAST, id DESC) rn2 FROM classes) WHERE rn2 = 1) k ON k.repo_id = b.repo_id AND k.name = b.n"),
    "resolve_implements": with_(["classes"], "SELECT DISTINCT b.repo_id, b.id AS src_id, coalesce(i.id, k.id) AS dst_id FROM (SELECT repo_id, id, unnest(interfaces) n FROM classes) b LEFT JOIN (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path DESC, start_line DESC NULLS LAST, id DESC) rn2 FROM classes WHERE language_type = 'interface') WHERE rn2 = 1) i ON i.repo_id = b.repo_id AND i.name = b.n LEFT JOIN (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path DESC, start_line DESC NULLS LAST, id DESC) rn2 FROM classes) WHERE rn2 = 1) k ON k.repo_id = b.repo_id AND k.name = b.n WHERE coalesce(i.id, k.id) IS NOT NULL"),
    "resolve_calls": with_(["funcs"], "SELECT c.repo_id, c.source_id AS src_id, f.id AS dst_id, '[' || max(c.line) || ']' AS line_numbers FROM (SELECT repo_id, source_id, list_extract(string_split(target_id, ':'), -1) n, TRY_CAST(regexp_extract(line_numbers, '\\d+') AS INTEGER) line FROM code_relationships WHERE rel_type = 'CALLS') c JOIN (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path NULLS FIRST, start_line NULLS FIRST, id) rn2 FROM funcs) WHERE rn2 = 1) f ON f.repo_id = c.repo_id AND f.name = c.n GROUP BY 1, 2, 3"),
    "incremental_merge": with_(["files"], "SELECT repo_id, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY scanned_at DESC, scan_id DESC) rn FROM code_files WHERE arrived_at < TIMESTAMP '2025-05-01') WHERE rn = 1 AND NOT coalesce(is_deleted, false) AND (repo_id, path) NOT IN (SELECT (repo_id, path) FROM code_files WHERE arrived_at >= TIMESTAMP '2025-05-01') UNION ALL SELECT repo_id, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY scanned_at DESC, scan_id DESC) rn2 FROM code_files WHERE (repo_id, path) IN (SELECT (repo_id, path) FROM code_files WHERE arrived_at >= TIMESTAMP '2025-05-01')) WHERE rn2 = 1 AND NOT coalesce(is_deleted, false)"),
    "file_scan_metadata": "SELECT DISTINCT repo_id, path, list_extract(string_split(path, '/'), -1) AS name, regexp_extract(path, '\\.[^./]*$') AS suffix, CAST(len(string_split(source, chr(10))) AS INTEGER) AS lines, md5(source) AS hash FROM file_sources",
    "duplicate_files": "SELECT md5(source) AS hash, count(*) AS copies, min(repo_id || '/' || path) AS first_path FROM (SELECT DISTINCT repo_id, path, source FROM file_sources) GROUP BY 1 HAVING count(*) > 1",
    "unique_keys": "SELECT label, repo_id, id, count(*) AS n FROM (SELECT 'Class' AS label, repo_id, id FROM code_classes UNION ALL SELECT 'Function', repo_id, id FROM code_functions UNION ALL SELECT 'File', repo_id, path FROM code_files) GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "fulltext_index": with_(["classes"], "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT repo_id, id, term, count(*) tf FROM (SELECT repo_id, id, unnest(list_filter(regexp_split_to_array(lower(coalesce(docstring, '')), '[^a-z0-9_]+'), lambda x: x <> '')) term FROM classes) GROUP BY 1, 2, 3) GROUP BY 1"),
    "search_vector": "SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round((1 + list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))) / 2, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE score > 0.3",
    "search_vector_top": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round((1 + list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))) / 2, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE score > 0.3) WHERE rank <= 10",
    "search_fulltext": with_(["funcs"], "SELECT d.repo_id, d.id, d.name, d.signature, d.docstring, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM (SELECT repo_id, id, len, w, len(list_filter(t, lambda x: x = w)) tf FROM (SELECT *, unnest(['and', 'buffer', 'cache', 'index', 'the']) w FROM doc)) h JOIN (SELECT w, count(*) df FROM (SELECT t, unnest(['and', 'buffer', 'cache', 'index', 'the']) w FROM doc) WHERE list_contains(t, w) GROUP BY 1) USING (w) CROSS JOIN (SELECT count(*) n, avg(len) avg_len FROM doc) JOIN funcs d ON d.repo_id = h.repo_id AND d.id = h.id WHERE tf > 0 GROUP BY ALL", "doc AS (SELECT repo_id, id, t, len(t) len FROM (SELECT repo_id, id, list_filter(regexp_split_to_array(lower(coalesce(docstring, '')), '[^a-z0-9_]+'), lambda x: x <> '') t FROM funcs) WHERE len(t) > 0)"),
    "search_fulltext_classes": with_(["classes"], "SELECT d.repo_id, d.id, d.name, d.docstring, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM (SELECT repo_id, id, len, w, len(list_filter(t, lambda x: x = w)) tf FROM (SELECT *, unnest(['and', 'buffer', 'cache', 'index', 'the']) w FROM doc)) h JOIN (SELECT w, count(*) df FROM (SELECT t, unnest(['and', 'buffer', 'cache', 'index', 'the']) w FROM doc) WHERE list_contains(t, w) GROUP BY 1) USING (w) CROSS JOIN (SELECT count(*) n, avg(len) avg_len FROM doc) JOIN classes d ON d.repo_id = h.repo_id AND d.id = h.id WHERE tf > 0 GROUP BY ALL", "doc AS (SELECT repo_id, id, t, len(t) len FROM (SELECT repo_id, id, list_filter(regexp_split_to_array(lower(coalesce(docstring, '')), '[^a-z0-9_]+'), lambda x: x <> '') t FROM classes) WHERE len(t) > 0)"),
    "parsed_functions": with_(["funcs"], "SELECT DISTINCT f.repo_id, f.id, f.name, f.start_line, f.end_line, f.is_async FROM funcs f SEMI JOIN file_sources s ON s.repo_id = f.repo_id AND s.path = f.path WHERE regexp_matches(f.path, '\\.(py|pyw|go)$')"),
    "parsed_classes": with_(["classes"], "SELECT DISTINCT c.repo_id, c.id, c.name, c.start_line, c.end_line FROM classes c SEMI JOIN file_sources s ON s.repo_id = c.repo_id AND s.path = c.path WHERE regexp_matches(c.path, '\\.pyw?$')"),
    "p1_found": "WITH r AS (SELECT * FROM code_files WHERE content_hash IS NOT NULL OR is_deleted IS NOT NULL), s AS (SELECT repo_id, max(started_at) since FROM index_runs WHERE status = 'success' GROUP BY 1), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY scanned_at DESC, scan_id DESC) rn FROM r) WHERE rn = 1), seen AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.repo_id, path ORDER BY scanned_at DESC, scan_id DESC) rn FROM r JOIN s ON s.repo_id = r.repo_id AND arrived_at <= since) WHERE rn = 1) SELECT c.repo_id, c.path FROM cur c LEFT JOIN seen n ON n.repo_id = c.repo_id AND n.path = c.path WHERE NOT coalesce(c.is_deleted, false) AND (n.path IS NULL OR coalesce(n.is_deleted, false) OR lower(trim(c.content_hash)) <> lower(trim(n.content_hash)))",
    "p4_found": with_(["refs", "known"], "SELECT rel_id, side FROM refs r WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.l = r.l AND k.id = r.id AND k.repo_id = r.key_repo)"),
    "p4_delta": with_(["refs", "known"], "SELECT rel_id, side FROM refs r WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.l = r.l AND k.id = r.id AND k.repo_id = r.key_repo)"),
    "p4_counts": with_(["refs", "known"], "SELECT rel_type, side, strftime(created_at, '%Y-%m') AS month, count(*) AS dangling FROM refs r WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.l = r.l AND k.id = r.id AND k.repo_id = r.key_repo) GROUP BY 1, 2, 3"),
    "p3_hierarchy": with_(["plinks"], "SELECT c.repo_id, c.id AS class_id, w.path, w.depth, w.root, coalesce(a.n, 0) AS descendants, coalesce(a.loop, false) AS on_cycle FROM classes c LEFT JOIN way w ON w.repo_id = c.repo_id AND w.id = c.id LEFT JOIN (SELECT repo_id, anc, count(*) FILTER (node <> anc) n, bool_or(node = anc) AS loop FROM up GROUP BY 1, 2) a ON a.repo_id = c.repo_id AND a.anc = c.id", "fp AS (SELECT repo_id, child, arg_min(parent, struct_pack(ord := ord, parent := parent)) parent FROM plinks GROUP BY 1, 2), up AS (SELECT repo_id, child node, parent anc FROM plinks UNION SELECT u.repo_id, u.node, e.parent FROM up u JOIN plinks e ON e.repo_id = u.repo_id AND e.child = u.anc), way AS (SELECT c.repo_id, c.id, c.name path, CAST(0 AS BIGINT) AS depth, c.id root FROM classes c WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.repo_id = c.repo_id AND fp.child = c.id) UNION ALL SELECT c.repo_id, c.id, w.path || '/' || c.name, w.depth + 1, w.root FROM way w JOIN fp ON fp.repo_id = w.repo_id AND fp.parent = w.id JOIN classes c ON c.repo_id = fp.repo_id AND c.id = fp.child)"),
    "p1_ledger": "WITH s AS (SELECT repo_id, max(started_at) since FROM index_runs WHERE status = 'success' GROUP BY 1), n AS (SELECT DISTINCT scan_id n, CAST(floor(scan_id / 16384) AS BIGINT) AS block FROM code_files JOIN s USING (repo_id) WHERE (content_hash IS NOT NULL OR is_deleted IS NOT NULL) AND arrived_at <= since), g AS (SELECT n, block, n - row_number() OVER (PARTITION BY block ORDER BY n) AS run FROM n) SELECT block, min(n) AS lo, max(n) AS hi FROM g GROUP BY block, run",
    "p3_found": with_(["plinks"], "SELECT DISTINCT repo_id, node AS class_id FROM up WHERE node = anc", "up AS (SELECT repo_id, child node, parent anc FROM plinks UNION SELECT u.repo_id, u.node, e.parent FROM up u JOIN plinks e ON e.repo_id = u.repo_id AND e.child = u.anc)"),
    "p3_descendants": with_(["plinks"], "SELECT repo_id, anc AS class_id, node AS descendant_id FROM up", "up AS (SELECT repo_id, child node, parent anc FROM plinks UNION SELECT u.repo_id, u.node, e.parent FROM up u JOIN plinks e ON e.repo_id = u.repo_id AND e.child = u.anc)"),
}
