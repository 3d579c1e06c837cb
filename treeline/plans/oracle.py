"""Oracle SQL from shared pieces: each query names the pieces it uses, and gets those they use in turn."""

from __future__ import annotations

import re

from treeline.sources import sample

_UP = "list_transform(range(0, len(string_split({0}, '/')) + {1}), lambda i: array_to_string(string_split({0}, '/')[1:i], '/'))"


def _view(sql: str, k: int | None = None) -> str:
    text = sql if k is None else sql.replace("{k}", str(k))
    return re.sub(r"\{(\w+)\}", r"\1", text)


def strict(path: str) -> str:
    return f"unnest({_UP.format(path, 0)})"


def with_self(path: str) -> str:
    return f"unnest({_UP.format(path, 1)})"


def _in(column: str, words: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


def _segment(words: tuple[str, ...]) -> str:
    return f"list_filter(string_split(lower(relative_path), '/')[1:-2], lambda s: {_in('s', words)})[1]"


_RULES = f"""CASE
 WHEN {_segment(('.venv', 'venv', 'node_modules', 'site-packages'))} IS NOT NULL THEN 'R110'
 WHEN {_segment(('.cache', 'cache', 'caches'))} IS NOT NULL THEN 'R120'
 WHEN {_segment(('build', 'dist', 'target', 'out'))} IS NOT NULL THEN 'R130'
 WHEN lower(name) IN ('pyproject.toml', 'package.json', 'cargo.toml', 'cmakelists.txt') OR lower(extension) IN ('.sln', '.csproj') THEN 'R210'
 WHEN {_in('lower(extension)', ('.py', '.rs', '.c', '.cc', '.cpp', '.h', '.hpp', '.js', '.ts', '.java'))} THEN 'R220'
 WHEN {_in('lower(extension)', ('.json', '.toml', '.yaml', '.yml', '.ini', '.cfg'))} THEN 'R230'
 WHEN lower(name) LIKE 'readme%' OR lower(extension) IN ('.md', '.rst') THEN 'R240'
 WHEN {_in('lower(extension)', ('.zip', '.7z', '.rar', '.tar', '.gz'))} THEN 'R250'
 WHEN {_in('lower(extension)', ('.exe', '.msi', '.dmg', '.pkg'))} THEN 'R260'
 WHEN {_in('lower(extension)', ('.wav', '.flac', '.mp3', '.png', '.jpg', '.jpeg', '.mov', '.mp4'))} THEN
   CASE WHEN {_segment(('exports', 'final exports', 'renders'))} IS NOT NULL THEN 'R310' ELSE 'R320' END
 ELSE 'R999' END"""

PIECES: dict[str, str] = {
    "f": _view(sample.FILES, -1),
    **{f"f{k}": _view(sample.FILES, k) for k in range(4)},
    **{f"e{k}": _view(sample.ERRORS, k) for k in range(4)},
    "rules": "SELECT * FROM (VALUES ('R110', 'DEPENDENCY_ENVIRONMENT', 0.96::DOUBLE), ('R120', 'CACHE', 0.96), ('R130', 'BUILD_OUTPUT', 0.96), ('R210', 'PROJECT_METADATA', 0.98), ('R220', 'SOURCE', 0.9), ('R230', 'CONFIGURATION', 0.82), ('R240', 'DOCUMENTATION', 0.86), ('R250', 'ARCHIVE', 0.88), ('R260', 'INSTALLER', 0.86), ('R310', 'FINAL_EXPORT', 0.84), ('R320', 'ORIGINAL_MEDIA', 0.55), ('R999', 'UNKNOWN', 0.1)) v(rule_id, role, confidence)",
    "r": f"SELECT x.*, role, confidence FROM (SELECT f.*, {_RULES} AS rule_id FROM f) x JOIN rules USING (rule_id)",
    "ra": f"SELECT relative_path, role, logical_bytes, {strict('relative_path')} AS dir FROM r",
    "dirs": f"SELECT DISTINCT dir AS relative_path FROM (SELECT {strict('relative_path')} AS dir FROM f) WHERE dir <> ''",
    "alldirs": "SELECT relative_path FROM dirs UNION ALL SELECT ''",
    "rc": "SELECT dir AS relative_path, role, count(*) AS n, sum(logical_bytes) AS bytes FROM ra GROUP BY dir, role",
    "dc": f"SELECT dir AS relative_path, count(*) AS directory_count FROM (SELECT {strict('relative_path')} AS dir FROM dirs) GROUP BY dir",
    "agg": "SELECT a.relative_path, coalesce(bytes, 0)::BIGINT AS recursive_bytes, coalesce(n, 0)::BIGINT AS file_count, coalesce(directory_count, 0)::BIGINT AS directory_count, CASE WHEN k IS NULL THEN 0.0 WHEN k = 1 THEN 1.0 ELSE 1.0 - h / ln(k) END::DOUBLE AS role_coherence FROM alldirs a LEFT JOIN (SELECT relative_path, sum(bytes) AS bytes, sum(n) AS n, count(*) AS k, -sum(p * ln(p)) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY relative_path) AS p FROM rc) GROUP BY relative_path) USING (relative_path) LEFT JOIN dc USING (relative_path)",
    "pr": "SELECT parent_path AS relative_path, sum(w)::BIGINT AS score, count(*)::BIGINT AS marker_count FROM (SELECT parent_path, CASE WHEN lower(name) IN ('pyproject.toml', 'package.json', 'cargo.toml') THEN 5 WHEN lower(name) = 'cmakelists.txt' THEN 4 WHEN lower(extension) IN ('.sln', '.csproj') THEN 5 END AS w FROM f) WHERE w IS NOT NULL GROUP BY 1 HAVING sum(w) >= 4",
    "feat": "SELECT a.relative_path, string_split(a.relative_path, '/')[1] || '|size2^' || CASE WHEN recursive_bytes <= 0 THEN 0 ELSE floor(log2(recursive_bytes))::BIGINT END AS cohort, recursive_bytes, file_count, coalesce(p, 0) / greatest(file_count, 1) AS preservation_ratio, coalesce(u, 0) / greatest(file_count, 1) AS unknown_ratio, role_coherence, (pr.relative_path IS NOT NULL)::INTEGER AS is_project FROM agg a LEFT JOIN (SELECT relative_path, sum(n) FILTER (role IN ('SOURCE', 'ORIGINAL_MEDIA', 'PROJECT_METADATA', 'CONFIGURATION'))::DOUBLE AS p, sum(n) FILTER (role = 'UNKNOWN')::DOUBLE AS u FROM rc GROUP BY 1) USING (relative_path) LEFT JOIN pr ON pr.relative_path = a.relative_path WHERE a.relative_path <> ''",
    "obj": "SELECT relative_path, cohort, -ln(1 + recursive_bytes) / max(ln(1 + recursive_bytes)) OVER () AS s, preservation_ratio AS p, unknown_ratio AS k, role_coherence AS c, least(1.0, unknown_ratio + CASE WHEN file_count < 3 THEN 0.15 ELSE 0.0 END) AS u FROM feat",
    "iv": "SELECT relative_path, cohort, s AS l0, s AS h0, greatest(0.0, p - u * 0.2) AS l1, least(1.0, p + u * 0.4) AS h1, k AS l2, least(1.0, u + 0.15) AS h2, 1 - c AS l3, 1 - c AS h3 FROM obj",
    "dom": "SELECT a.cohort, a.relative_path AS winner, b.relative_path AS loser FROM iv a JOIN iv b ON a.cohort = b.cohort AND a.relative_path <> b.relative_path WHERE a.h0 <= b.l0 AND a.h1 <= b.l1 AND a.h2 <= b.l2 AND a.h3 <= b.l3 AND (a.h0 < b.l0 OR a.h1 < b.l1 OR a.h2 < b.l2 OR a.h3 < b.l3)",
    "lvl": "SELECT relative_path, 0 AS r FROM iv UNION SELECT dom.loser, lvl.r + 1 FROM lvl JOIN dom ON dom.winner = lvl.relative_path",
    "rank": "SELECT iv.relative_path, cohort, max(r)::BIGINT AS pareto_rank FROM iv JOIN lvl USING (relative_path) GROUP BY ALL",
    "items": "SELECT 'directory' AS kind, relative_path, '' AS extension, 0::BIGINT AS logical_bytes, NULL::BIGINT AS modified_ns, len(string_split(relative_path, '/'))::BIGINT AS depth FROM dirs UNION ALL SELECT 'file', relative_path, extension, logical_bytes, modified_ns, depth FROM f",
    "dec": f"SELECT * FROM ({_view(sample.DECISIONS)}) WHERE relative_path IN (SELECT relative_path FROM dirs)",
    "cur": "SELECT relative_path, arg_max(decision, (ts, event_id)) AS decision, count(*)::BIGINT AS revision FROM dec GROUP BY relative_path",
}


def _changes(n: int) -> None:
    """Pieces of transition n: ch (changes), dch (by directory), pb/pc (projects), nodes."""
    b, c = n, n + 1
    under = lambda e: f"EXISTS (SELECT 1 FROM {e} e WHERE e.relative_path = p OR starts_with(p, e.relative_path || '/') OR starts_with(e.relative_path, p || '/'))"
    PIECES[f"ch{n}"] = f"""SELECT p AS relative_path, t AS change_type, CASE t WHEN 'ADDED' THEN CASE WHEN {under(f'e{b}')} THEN 'AMBIGUOUS_ERROR_REGION' ELSE 'OBSERVED_CURRENT' END
      WHEN 'REMOVED' THEN CASE WHEN {under(f'e{c}')} THEN 'AMBIGUOUS_ERROR_REGION' ELSE 'OBSERVED_BASELINE' END ELSE 'OBSERVED_BOTH' END AS confidence, x, y
      FROM (SELECT coalesce(a.relative_path, b.relative_path) AS p, a.logical_bytes AS x, b.logical_bytes AS y, CASE WHEN a.relative_path IS NULL THEN 'ADDED' WHEN b.relative_path IS NULL THEN 'REMOVED'
        WHEN (a.logical_bytes, a.modified_ns, a.attributes) IS NOT DISTINCT FROM (b.logical_bytes, b.modified_ns, b.attributes) THEN 'METADATA_UNCHANGED' ELSE 'METADATA_CHANGED' END AS t
        FROM f{b} a FULL JOIN f{c} b ON a.relative_path = b.relative_path)"""
    PIECES[f"cd{n}"] = f"SELECT DISTINCT dir AS relative_path FROM (SELECT {strict('relative_path')} AS dir FROM ch{n})"
    PIECES[f"dch{n}"] = f"""SELECT relative_path, count(*) FILTER (change_type = 'ADDED') AS added, count(*) FILTER (change_type = 'REMOVED') AS removed, count(*) FILTER (change_type = 'METADATA_CHANGED') AS changed,
      count(*) FILTER (change_type = 'METADATA_UNCHANGED') AS unchanged, count(*) FILTER (confidence = 'AMBIGUOUS_ERROR_REGION') AS ambiguous, sum(coalesce(y, 0) - coalesce(x, 0))::BIGINT AS bytes_delta,
      count(*) FILTER (change_type <> 'METADATA_UNCHANGED') / count(*) AS churn FROM (SELECT {strict('relative_path')} AS relative_path, change_type, confidence, x, y FROM ch{n}) GROUP BY 1"""
    PIECES[f"nodes{n}"] = f"""SELECT coalesce(b.relative_path, c.relative_path) AS project, CASE WHEN b.relative_path IS NOT NULL AND c.relative_path IS NOT NULL THEN 'RETAINED' WHEN c.relative_path IS NOT NULL THEN 'ADDED' ELSE 'REMOVED' END AS state,
      coalesce(changed, 0)::BIGINT AS changed, coalesce(ambiguous, 0)::BIGINT AS ambiguous, coalesce(current_files, 0)::BIGINT AS current_files
      FROM pr_{b} b FULL JOIN pr_{c} c ON b.relative_path = c.relative_path
      LEFT JOIN (SELECT project, count(*) AS changed, count(*) FILTER (confidence = 'AMBIGUOUS_ERROR_REGION') AS ambiguous FROM (
        SELECT ch.relative_path, confidence, arg_max(p.relative_path, len(p.relative_path)) AS project FROM ch{n} ch JOIN (SELECT 'REMOVED' AS side, relative_path FROM pr_{b} UNION ALL SELECT 'HERE', relative_path FROM pr_{c}) p
          ON p.side = CASE WHEN change_type = 'REMOVED' THEN 'REMOVED' ELSE 'HERE' END AND starts_with(ch.relative_path, p.relative_path || '/') WHERE change_type <> 'METADATA_UNCHANGED' GROUP BY ALL) GROUP BY project) m ON m.project = coalesce(b.relative_path, c.relative_path)
      LEFT JOIN (SELECT project, count(*) AS current_files FROM (SELECT fc.relative_path, arg_max(p.relative_path, len(p.relative_path)) AS project FROM f{c} fc JOIN pr_{c} p ON starts_with(fc.relative_path, p.relative_path || '/') GROUP BY 1) GROUP BY project) h ON h.project = coalesce(b.relative_path, c.relative_path)"""


for _k in range(4):
    PIECES[f"pr_{_k}"] = f"SELECT DISTINCT parent_path AS relative_path FROM f{_k} WHERE lower(name) IN ('pyproject.toml', 'package.json')"
for _n in range(3):
    _changes(_n)


def oracle(final: str, **own: str) -> str:
    """``final`` with all pieces that it and they use, in an order that SQL takes."""
    pieces = PIECES | own
    order: list[str] = []

    def need(text: str, me: str = "") -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in pieces and name != me and name not in order and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need(pieces[name], name)
                if name not in order:
                    order.append(name)

    need(final)
    head = ", ".join(f"{n} AS ({pieces[n]})" for n in order)
    return f"WITH RECURSIVE {head} {final}" if head else final
