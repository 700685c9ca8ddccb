"""The canonical relations, as DDL."""

RELATIONS = {
    "files": "path string, language string, loc int, bytes long",
    "import_edges": "`from` string, `to` string, kind string, line int",
    "graph_nodes": "id string, language string, loc int, in_degree long, out_degree long, is_entry_point boolean, depth_from_entry int",
    "graph_edges": "`from` string, `to` string, line int",
    "functions": "file string, name string, start_line int, end_line int, loc int, params int, cyclomatic int, cognitive int, body_hash string",
    "file_metrics": "path string, function_count long, max_cyclomatic int, total_cyclomatic long, max_cognitive int, longest_function_loc int, avg_cyclomatic double",
    "commits": "commit string, path string, author string, ts timestamp",
    "surface_items": "file string, language string, kind string, name string, signature string, line int, method string",
    "owner_rules": "ordinal int, pattern string, owners array<string>",
    "diff_files": "path string, old_path string, status string, additions long, deletions long",
    "violations": "rule string, summary string, file string, line int, detail string",
    "named_commands": "name string, command string, source string, purpose string",
    "markers": "file string, line int, kind string, text string",
    "chunks": "id long, file string, lang string, kind string, name string, start_line int, end_line int, content string",
    "postings": "term string, id long, field string, tf long, len long",
    "vectors": "chunk_id long, embedding array<float>",
    "occurrences": (
        "doc string, occ int, symbol string, is_def boolean, start_line int, start_char int, end_line int, end_char int, "
        "enc_start_line int, enc_start_char int, enc_end_line int, enc_end_char int"
    ),
    "symbols": "symbol string, display_name string, kind int, external boolean",
    "snapshots": (
        "id long, ts timestamp, score double, complexity double, acyclicity double, dead_code double, coupling double, "
        "hot_functions array<struct<file:string,name:string,cyclomatic:int>>"
    ),
    "pins": "id long, scope string, target string, note string, created_at timestamp, expires_at timestamp",
    "notes": "id long, scope string, kind string, content string, created_at timestamp, ttl_days int, session_id string, embedding array<float>",
    "note_edges": "from_id long, to_id long, kind string",
    "sessions": "id string, started_at timestamp, ended_at timestamp, summary string",
    "apps": "app string, path string, files long, loc long, primary_language string",
    "fleet_surface": "app string, kind string, name string, method string, file string, line int",
    "fleet_hotspots": "app string, path string, churn long, complexity long, score double",
    "fleet_test_mapping": "app string, source string, test string",
    "fleet_file_complexity": "app string, file string, total_cyclomatic long, loc long",
    "diagnostics": "tool string, rule string, severity string, message string, file string, line int, column int, end_line int, end_column int, url string, category string",
    "tool_status": "tool string, available boolean, ran boolean, version string, findings long, error string",
    "artifacts": "name string, description string, paths array<string>, `when` string",
    "components": "file string, name string, description string, props array<struct<required:boolean,name:string,type:string,description:string>>",
    "diff_overlay": "path string, is_hotspot boolean, is_gap boolean",
}
