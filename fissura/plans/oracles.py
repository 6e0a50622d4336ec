"""The registered queries in plain SQL, stated per pixel where that is simpler.

Written for DuckDB against the same tables. Masks are sets of pixels here, the
outside is a recursive flood from the frame, thick lines are a join with the
disc: no step follows the Spark plans.
"""

from fissura.functions import names, params
from fissura.operators import validation
from fissura.plans import fixtures as fx


def _list(texts) -> str:
    return "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in texts) + "]"


def _pick(texts, index: str) -> str:
    return f"{_list(texts)}[({index} % {len(texts)}) + 1]"


def _query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def _det(image: str, keep: str) -> str:
    return f"""det AS (
  SELECT ({image})::BIGINT AS image_id, vec_id AS instance_id, list_max(embedding) AS conf, embedding
  FROM embeddings WHERE {keep})"""


def _hot(threshold) -> str:
    return f"""hot AS (
  SELECT image_id, instance_id, conf, (p // 8)::INTEGER AS y, (p % 8)::INTEGER AS x
  FROM (SELECT image_id, instance_id, conf, unnest(embedding) AS v,
               generate_subscripts(embedding, 1) - 1 AS p FROM det)
  WHERE v > {threshold}::FLOAT)"""


def _runs(name: str, pixels: str, keys: str = "image_id") -> str:
    return f"""{name} AS (
  SELECT {keys}, y, min(x)::INTEGER AS x0, (max(x) + 1)::INTEGER AS x1
  FROM (SELECT {keys}, y, x, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS island
        FROM (SELECT DISTINCT {keys}, y, x FROM {pixels}))
  GROUP BY {keys}, y, island)"""


SITE = _det("label", "list_max(embedding) >= 0.35::FLOAT")
SITES = "site AS (SELECT DISTINCT label::BIGINT AS image_id FROM embeddings)"

FRAMES = """frame AS (
  SELECT image_id, (image_id % 16 + 5)::INTEGER AS height, (image_id % 8 + 13)::INTEGER AS width,
         (image_id % 5) / 4.0::DOUBLE AS alpha, (image_id % 5)::INTEGER AS outline,
         ((image_id % 4 * 5 + 20) / 100.0::DOUBLE)::FLOAT AS conf,
         [image_id * 37 % 256, image_id * 91 % 256, image_id * 53 % 256] AS colour
  FROM (SELECT DISTINCT vec_id // 4 AS image_id FROM embeddings))"""

GRID = """grid AS (
  SELECT f.image_id, f.height, f.width, y::INTEGER AS y, x::INTEGER AS x
  FROM frame f, unnest(range(f.height)) AS r(y), unnest(range(f.width)) AS c(x))"""

FRAME_DET = _det("vec_id // 4", "list_max(embedding) >= 0.2::FLOAT")
ANY_DET = _det("vec_id // 4", "TRUE")


def _mask(keep: str = "TRUE") -> str:
    return f"""mask AS (
  SELECT DISTINCT g.image_id, g.height, g.width, g.y, g.x
  FROM grid g JOIN hot h ON h.image_id = g.image_id
    AND h.y = g.y * 8 // g.height AND h.x = g.x * 8 // g.width
  JOIN frame f ON f.image_id = g.image_id WHERE {keep})"""


def _outside(images: str) -> str:
    return f"""step(dy, dx) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
outside AS (
  SELECT image_id, -1 AS y, -1 AS x FROM {images}
  UNION
  SELECT o.image_id, o.y + s.dy, o.x + s.dx
  FROM outside o CROSS JOIN step s JOIN {images} f ON f.image_id = o.image_id
  LEFT JOIN mask m ON m.image_id = o.image_id AND m.y = o.y + s.dy AND m.x = o.x + s.dx
  WHERE m.image_id IS NULL AND o.y + s.dy BETWEEN -1 AND f.height AND o.x + s.dx BETWEEN -1 AND f.width),
edge AS (
  SELECT DISTINCT m.image_id, m.y, m.x FROM mask m CROSS JOIN step s
  JOIN outside o ON o.image_id = m.image_id AND o.y = m.y + s.dy AND o.x = m.x + s.dx)"""


THICK = """thick AS (
  SELECT DISTINCT e.image_id, (e.y + dy)::INTEGER AS y, (e.x + dx)::INTEGER AS x
  FROM edge e JOIN frame f ON f.image_id = e.image_id,
       unnest(range(-5, 6)) AS a(dy), unnest(range(-5, 6)) AS b(dx)
  WHERE f.outline > 0 AND 4 * (dy * dy + dx * dx) <= f.outline * f.outline
    AND e.y + dy >= 0 AND e.y + dy < f.height AND e.x + dx >= 0 AND e.x + dx < f.width)"""

NO_THICK = "thick AS (SELECT image_id, y, x FROM mask WHERE FALSE)"

PAINTED = """painted AS (
  SELECT g.image_id, g.y, g.x, f.alpha, f.colour, t.image_id IS NOT NULL AS drawn,
         m.image_id IS NOT NULL AS inside,
         list_transform([0, 1, 2], lambda c: (g.image_id * 31 + g.y * 7 + g.x * 3 + c * 11) % 256) AS px
  FROM grid g JOIN frame f ON f.image_id = g.image_id
  LEFT JOIN mask m ON m.image_id = g.image_id AND m.y = g.y AND m.x = g.x
  LEFT JOIN thick t ON t.image_id = g.image_id AND t.y = g.y AND t.x = g.x)"""


def _channel(k: int) -> str:
    return (
        f"(CASE WHEN drawn THEN colour[{k}] WHEN inside THEN round_even("
        f"px[{k}]::DOUBLE * (1 - alpha) + colour[{k}]::DOUBLE * alpha, 0) "
        f"ELSE px[{k}] END)::INTEGER AS {'bgr'[k - 1]}"
    )


PAINTED_PIXELS = f"SELECT image_id, y, x, {_channel(1)}, {_channel(2)}, {_channel(3)} FROM painted"

OVERLAY = _query(
    FRAMES, GRID, ANY_DET, _hot(0.1), _mask("h.conf >= f.conf"), _outside("frame"), THICK, PAINTED,
    select=PAINTED_PIXELS,
)

_FLOAT = r"[+-]?(((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?|(?i:inf|infinity|nan))"
_INT = r"[+-]?\d(_?\d)*"


def _number(text: str, pattern: str) -> str:
    bare = rf"regexp_replace({text}, '\s|_', '', 'g')"
    return (
        rf"CASE WHEN regexp_full_match({text}, '\s*{pattern}\s*') THEN "
        f"CASE WHEN lower({bare}) IN ('nan', '+nan', '-nan') THEN 'nan'::DOUBLE "
        f"ELSE TRY_CAST({bare} AS DOUBLE) END END"
    )


def _raw_params(conf, alpha, outline) -> str:
    return f"""raw AS (
  SELECT event_id, {_pick(conf, 'event_id')} AS c, {_pick(alpha, 'event_id')} AS a,
         {_pick(outline, 'event_id')} AS o FROM events),
typed AS (
  SELECT event_id, c, a, o, {_number('c', _FLOAT)} AS cv, {_number('a', _FLOAT)} AS av,
         {_number('o', _INT)} AS ov FROM raw)"""


def _clamp(value: str, low, high) -> str:
    return f"CASE WHEN isnan({value}) THEN {value} ELSE least(greatest({value}, {low}::DOUBLE), {high}::DOUBLE) END"


_PARAM_OUT = """SELECT event_id, CASE WHEN NOT isnan(conf) THEN conf END AS conf,
  isnan(conf) AS conf_is_nan, alpha, outline::INTEGER AS outline FROM final"""

_ALLOWED = "(" + ", ".join(f"'{s}'" for s in names.ALLOWED_SUFFIXES) + ")"

UPLOADS = f"""upload AS (
  SELECT doc_id::VARCHAR AS upload_id, n_chars * 1000 AS length,
         CASE WHEN doc_id % 37 = 5 THEN NULL WHEN doc_id % 41 = 5 THEN ''
              ELSE 'doc_' || doc_id || {_pick(fx.UPLOAD_EXTENSIONS, 'doc_id')} END AS filename
  FROM documents),
checked AS (
  SELECT *, CASE WHEN length > {names.MAX_UPLOAD_BYTES} THEN 'too_large'
                 WHEN coalesce(filename, '') = '' THEN 'missing'
                 WHEN ext NOT IN {_ALLOWED} THEN 'unsupported_type' END AS reject_reason
  FROM (SELECT *, CASE WHEN filename IS NULL THEN NULL WHEN strpos(base, '.') > 0 AND NOT starts_with(reverse(base), '.')
                         AND length(base) > strpos(reverse(base), '.')
                       THEN lower(right(base, strpos(reverse(base), '.'))) ELSE '' END AS ext
        FROM (SELECT *, string_split(filename, '/')[-1] AS base FROM upload)))"""

_PLANES = """plane AS (
  SELECT vec_id AS image_id, c::INTEGER AS c, p, (floor(abs(v::DOUBLE) * 1000)::INTEGER + c * 11) % 256 AS px
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
       unnest([0, 1, 2]) AS k(c)),
failed AS (SELECT image_id FROM plane WHERE p = 0 AND c = 0 AND px % 10 = 7),
channel AS (
  SELECT image_id, c FROM plane WHERE image_id NOT IN (SELECT image_id FROM failed)
  GROUP BY image_id, c HAVING max(px)::FLOAT / 255::FLOAT >= 0.8::FLOAT)"""

SPECKLES = """mask AS (
  SELECT DISTINCT l_suppkey AS image_id, (l_partkey % 24)::INTEGER AS y,
         unnest(range(l_orderkey % 60, l_orderkey % 60 + 1 + l_linenumber % 4))::INTEGER AS x FROM lineitem),
plate AS (SELECT DISTINCT image_id, 24 AS height, 64 AS width FROM mask)"""

ALL = {
    "masked_area": _query(
        SITE, _hot(0.1), SITES,
        select="""SELECT s.image_id, coalesce(d.n, 0)::BIGINT AS num_instances,
  coalesce(h.n, 0)::BIGINT AS mask_area FROM site s
  LEFT JOIN (SELECT image_id, count(*) AS n FROM det GROUP BY image_id) d ON d.image_id = s.image_id
  LEFT JOIN (SELECT image_id, count(DISTINCT (y, x)) AS n FROM hot GROUP BY image_id) h
    ON h.image_id = s.image_id""",
    ),
    "upload_validation": _query(
        UPLOADS,
        select=f"""SELECT upload_id, filename, ext, reject_reason, CASE reject_reason
  WHEN 'too_large' THEN '{validation.TOO_LARGE_MESSAGE}'
  WHEN 'missing' THEN '{validation.MISSING_MESSAGE}'
  WHEN 'unsupported_type' THEN '{validation.UNSUPPORTED_MESSAGE}' END AS reject_message FROM checked""",
    ),
    "upload_report": _query(
        UPLOADS,
        f"""told AS (SELECT *, upload_id::BIGINT AS i FROM checked)""",
        select=f"""SELECT upload_id AS path, filename, length,
  CASE WHEN reject_reason IS NOT NULL THEN reject_reason WHEN coalesce(length, 0) = 0 THEN 'empty'
       WHEN i % 13 = 3 THEN 'absent' WHEN i % 7 = 1 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN reject_reason = 'too_large' THEN '{validation.TOO_LARGE_MESSAGE}'
       WHEN reject_reason = 'missing' THEN '{validation.MISSING_MESSAGE}'
       WHEN reject_reason = 'unsupported_type' THEN '{validation.UNSUPPORTED_MESSAGE}'
       WHEN coalesce(length, 0) = 0 THEN '{validation.EMPTY_MESSAGE}'
       WHEN i % 13 = 3 THEN '{validation.ABSENT_MESSAGE}' WHEN i % 7 = 1 THEN 'Inference failed: x'
       WHEN i % 4 = 0 THEN 'No cracks detected' WHEN i % 4 = 1 THEN 'Found 1 crack instance'
       ELSE 'Found ' || (i % 4) || ' crack instances' END AS message FROM told""",
    ),
    "upload_naming": _query(
        UPLOADS,
        select="""SELECT upload_id, k || ext AS upload_name, k || '_overlay.jpg' AS result_name
  FROM (SELECT *, sha256('=' || upload_id || chr(0) || '=' || filename || chr(0) || '=' || length) AS k FROM checked WHERE reject_reason IS NULL)""",
    ),
    "output_name_collisions": f"""SELECT source || '/' || regexp_replace(file, '(.)\\.[^.]+$', '\\1') || '_overlay.jpg' AS out_path,
  count(*)::BIGINT AS n_inputs
  FROM (SELECT source, 'photo.' || (doc_id // 3) || {_pick(fx.UPLOAD_EXTENSIONS, 'doc_id')} AS file FROM documents)
  GROUP BY 1 HAVING count(*) > 1""",
    "param_parse_clamp": _query(
        _raw_params(fx.CONF_TEXTS, fx.ALPHA_TEXTS, fx.OUTLINE_TEXTS),
        f"""checked AS (
  SELECT *, (c IS NULL OR cv IS NOT NULL) AND (a IS NULL OR av IS NOT NULL)
            AND (o IS NULL OR ov IS NOT NULL) AS ok FROM typed),
filled AS (
  SELECT event_id, CASE WHEN ok THEN coalesce(cv, 0.25) ELSE 0.25 END AS cf,
         CASE WHEN ok THEN coalesce(av, 0.5) ELSE 0.5 END AS af,
         CASE WHEN ok THEN coalesce(ov, 2) ELSE 2 END AS o_f FROM checked),
final AS (
  SELECT event_id, {_clamp('cf', 0, 1)} AS conf, {_clamp('af', 0, 1)} AS alpha,
         {_clamp('o_f', 0, 10)} AS outline FROM filled)""",
        select=_PARAM_OUT,
    ),
    "param_strict": _query(
        _raw_params(fx.STRICT_CONF_TEXTS, fx.STRICT_ALPHA_TEXTS, fx.STRICT_OUTLINE_TEXTS),
        """wrong AS (
  SELECT *, CASE WHEN c IS NOT NULL AND cv IS NULL THEN 'invalid conf value: ' || c
                 WHEN a IS NOT NULL AND av IS NULL THEN 'invalid alpha value: ' || a
                 WHEN o IS NOT NULL AND ov IS NULL THEN 'invalid outline value: ' || o END AS error FROM typed),
final AS (
  SELECT event_id, error, CASE WHEN error IS NULL THEN coalesce(cv, 0.25) END AS conf,
         CASE WHEN error IS NULL THEN coalesce(av, 0.5) END AS alpha,
         CASE WHEN error IS NULL THEN least(greatest(coalesce(ov, 2), -2147483648), 2147483647) END AS outline
  FROM wrong)""",
        select=_PARAM_OUT.replace("event_id,", "event_id, error,").replace(
            "isnan(conf) AS", "coalesce(isnan(conf), FALSE) AS"
        ),
    ),
    "colour_parse": _query(
        f"raw AS (SELECT event_id, {_pick(fx.COLOUR_TEXTS, 'event_id')} AS t FROM events)",
        "parts AS (SELECT event_id, string_split(t, ',') AS p FROM raw)",
        rf"""parsed AS (
  SELECT event_id, len(p) = 3 AND len(list_filter(p, lambda s: regexp_full_match(s, '\s*{_INT}\s*'))) = 3 AS ok,
         list_transform(p, lambda s: least(greatest(TRY_CAST(trim(s) AS BIGINT), 0), 255)::INTEGER) AS v
  FROM parts)""",
        select="""SELECT event_id, CASE WHEN ok THEN v[1] END AS b, CASE WHEN ok THEN v[2] END AS g,
  CASE WHEN ok THEN v[3] END AS r FROM parsed""",
    ),
    "colour_strict": _query(
        f"raw AS (SELECT event_id, {_pick(fx.COLOUR_TEXTS, 'event_id')} AS t FROM events)",
        "parts AS (SELECT event_id, t, string_split(t, ',') AS p FROM raw)",
        rf"""parsed AS (
  SELECT event_id, t, len(p) = 3 AND len(list_filter(p, lambda s: regexp_full_match(s, '\s*{_INT}\s*'))) = 3 AS ok,
         list_transform(p, lambda s: least(greatest(TRY_CAST(trim(s) AS BIGINT), 0), 255)::INTEGER) AS v
  FROM parts)""",
        select=f"""SELECT event_id, CASE WHEN t IS NULL THEN 0 WHEN ok THEN v[1] END AS b,
  CASE WHEN t IS NULL THEN 0 WHEN ok THEN v[2] END AS g, CASE WHEN t IS NULL THEN 255 WHEN ok THEN v[3] END AS r,
  CASE WHEN t IS NOT NULL AND NOT ok THEN '{params.COLOUR_MESSAGE.replace("'", "''")}' END AS error FROM parsed""",
    ),
    "linear_scores": """SELECT vec_id AS image_id,
  round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i / 64)), 4) AS score FROM embeddings""",
    "conf_filter_count": _query(
        _det("label", "list_max(embedding) >= 0.42::FLOAT"), SITES,
        select="""SELECT s.image_id, count(d.instance_id)::BIGINT AS num_instances
  FROM site s LEFT JOIN det d ON d.image_id = s.image_id GROUP BY s.image_id""",
    ),
    "mask_binarise_runs": _query(
        _det("label", "TRUE"), _hot(0.1), _runs("run", "hot", "image_id, instance_id"),
        select="SELECT * FROM run",
    ),
    "mask_default_threshold": _query(
        _det("label", "TRUE"), _hot(0.5), _runs("run", "hot", "image_id, instance_id"),
        select="SELECT * FROM run",
    ),
    "mask_union_runs": _query(SITE, _hot(0.1), _runs("run", "hot"), select="SELECT * FROM run"),
    "instance_run_union": _query(
        """px AS (
  SELECT l_partkey AS image_id, (l_linenumber - 1)::INTEGER AS y,
         unnest(range(l_orderkey % 480, l_orderkey % 480 + l_quantity::BIGINT)) AS x FROM lineitem)""",
        _runs("run", "px"),
        select="SELECT * FROM run",
    ),
    "mask_resize_runs": _query(
        FRAMES, GRID, FRAME_DET, _hot(0.1), _mask(), _runs("run", "mask"), select="SELECT * FROM run"
    ),
    "blend_pixels": _query(
        FRAMES, GRID, FRAME_DET, _hot(0.1), _mask(), NO_THICK, PAINTED, select=PAINTED_PIXELS
    ),
    "outline_pixels": _query(
        FRAMES, GRID, FRAME_DET, _hot(0.1), _mask(), _outside("frame"), select="SELECT * FROM edge"
    ),
    "outline_speckle": _query(
        SPECKLES,
        _outside("plate"), _runs("run", "edge"),
        select="SELECT * FROM run",
    ),
    "outline_strips": _query(
        SPECKLES, _outside("plate"), _runs("run", "edge"), select="SELECT * FROM run",
    ),
    "outline_thick": _query(
        FRAMES, GRID, FRAME_DET, _hot(0.1), _mask(), _outside("frame"), THICK,
        select="SELECT * FROM thick",
    ),
    "outline_thick_wide": _query(
        FRAMES.replace("(image_id % 5)::INTEGER AS outline", "(image_id * 7 % 60)::INTEGER AS outline"),
        GRID, FRAME_DET, _hot(0.1), _mask(), _outside("frame"), THICK.replace("-5, 6", "-30, 31"),
        select="SELECT * FROM thick",
    ),
    "overlay_pixels": OVERLAY,
    "overlay_sink": OVERLAY,
    "detection_report": _query(
        _PLANES,
        select="""SELECT i.vec_id AS image_id,
  CASE WHEN f.image_id IS NULL THEN coalesce(n, 0)::BIGINT END AS num_instances,
  CASE WHEN f.image_id IS NULL THEN 'planes/' || i.vec_id || '_overlay.jpg' END AS out_path,
  CASE WHEN f.image_id IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN f.image_id IS NOT NULL THEN 'Inference failed: forced failure'
       WHEN coalesce(n, 0) = 0 THEN 'No cracks detected'
       WHEN n = 1 THEN 'Found 1 crack instance' ELSE 'Found ' || n || ' crack instances' END AS message,
  CASE WHEN f.image_id IS NOT NULL THEN 'Inference failed: forced failure' END AS error
  FROM embeddings i LEFT JOIN failed f ON f.image_id = i.vec_id
  LEFT JOIN (SELECT image_id, count(*) AS n FROM channel GROUP BY image_id) c ON c.image_id = i.vec_id""",
    ),
    "result_files": _query(
        _PLANES,
        """frame AS (SELECT DISTINCT image_id, 8 AS height, 8 AS width, 1 AS outline FROM plane
  WHERE image_id NOT IN (SELECT image_id FROM failed)),
mask AS (
  SELECT DISTINCT p.image_id, (p.p // 8)::INTEGER AS y, (p.p % 8)::INTEGER AS x
  FROM plane p JOIN channel k ON k.image_id = p.image_id AND k.c = p.c
  WHERE p.px::FLOAT / 255::FLOAT > 0.5::FLOAT)""",
        _outside("frame"),
        """whole AS (
  SELECT p.image_id, (p.p // 8)::INTEGER AS y, (p.p % 8)::INTEGER AS x, p.c,
         CASE WHEN e.image_id IS NOT NULL THEN [0, 0, 255][p.c + 1]
              WHEN m.image_id IS NOT NULL THEN round_even(p.px * 0.5::DOUBLE + [0, 0, 255][p.c + 1] * 0.5::DOUBLE, 0)
              ELSE p.px END::INTEGER AS v
  FROM plane p JOIN frame f ON f.image_id = p.image_id
  LEFT JOIN mask m ON m.image_id = p.image_id AND m.y = p.p // 8 AND m.x = p.p % 8
  LEFT JOIN edge e ON e.image_id = p.image_id AND e.y = p.p // 8 AND e.x = p.p % 8)""",
        select="""SELECT image_id, y, x, max(v) FILTER (c = 0) AS b, max(v) FILTER (c = 1) AS g,
  max(v) FILTER (c = 2) AS r FROM whole GROUP BY image_id, y, x""",
    ),
    "file_manifest": _query(
        FRAMES,
        """named AS (
  SELECT CASE WHEN image_id % 7 = 0 THEN NULL WHEN image_id % 11 = 0 THEN 'frames/frame_' || image_id || '.bmp'
              ELSE 'frame_' || image_id || '.bmp' END AS name,
         (54 + height * ((width * 3 + 3) // 4 * 4))::BIGINT AS bytes FROM frame)""",
        select="""SELECT name, CASE WHEN name LIKE 'frame_%' AND name NOT LIKE '%/%' THEN bytes END AS size,
  CASE WHEN name IS NULL THEN 'no name' WHEN name LIKE '%/%' THEN 'not a file name' END AS error,
  CASE WHEN name LIKE 'frame_%' AND name NOT LIKE '%/%' THEN bytes END AS length FROM named""",
    ),
    "scored_batches": _query(
        FRAMES, GRID,
        """hit AS (
  SELECT image_id, y, x, (image_id * 31 + y * 7 + x * 3) % 256 > 127 AS blue,
         (image_id * 31 + y * 7 + x * 3 + 11) % 256 > 200 AS green FROM grid),
counted AS (
  SELECT image_id, image_id * 31 % 256 % 10 = 7 AS bad, max(blue::INTEGER) + max(green::INTEGER) AS n,
         count(*) FILTER (blue OR green) AS area FROM hit GROUP BY image_id)""",
        select="""SELECT image_id, CASE WHEN bad THEN 0 ELSE n END::BIGINT AS num_instances,
  CASE WHEN bad THEN 0 ELSE area END::BIGINT AS mask_area,
  CASE WHEN bad THEN 'Inference failed: forced failure' END AS error FROM counted""",
    ),
    "stream_detect": _query(
        FRAMES, GRID,
        """hit AS (
  SELECT image_id, y, x, (image_id * 31 + y * 7 + x * 3) % 256 > 127 AS blue,
         (image_id * 31 + y * 7 + x * 3 + 11) % 256 > 200 AS green FROM grid)""",
        select="""SELECT 'frame_' || image_id || '.bmp' AS file,
  (max(blue::INTEGER) + max(green::INTEGER))::BIGINT AS num_instances,
  count(*) FILTER (blue OR green)::BIGINT AS mask_area FROM hit GROUP BY image_id""",
    ),
    "stream_results": _query(
        FRAMES, GRID,
        """hit AS (
  SELECT image_id, height, width, (image_id * 31 + y * 7 + x * 3) % 256 > 127 AS blue,
         (image_id * 31 + y * 7 + x * 3 + 11) % 256 > 200 AS green FROM grid),
counted AS (
  SELECT image_id, height, width, image_id * 31 % 256 % 10 = 7 AS bad,
         (max(blue::INTEGER) + max(green::INTEGER))::BIGINT AS n FROM hit GROUP BY ALL)""",
        select="""SELECT 'frame_' || image_id || '.bmp' AS file, CASE WHEN NOT bad THEN n END AS num_instances,
  CASE WHEN bad THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN bad THEN 'Inference failed: forced failure' WHEN n = 0 THEN 'No cracks detected'
       WHEN n = 1 THEN 'Found 1 crack instance' ELSE 'Found ' || n || ' crack instances' END AS message,
  CASE WHEN NOT bad THEN height END AS height, CASE WHEN NOT bad THEN width END AS width FROM counted""",
    ),
    "scored_words": _query(
        _PLANES,
        """hot AS (
  SELECT p.image_id, p.c::BIGINT AS instance_id, (p.p // 8)::INTEGER AS y, (p.p % 8)::INTEGER AS x
  FROM plane p JOIN channel k ON k.image_id = p.image_id AND k.c = p.c WHERE p.px > 128)""",
        _runs("run", "hot", "image_id, instance_id"),
        select="SELECT * FROM run",
    ),
    "scored_masks": _query(
        _PLANES,
        """hot AS (
  SELECT p.image_id, p.c::BIGINT AS instance_id, (p.p // 8)::INTEGER AS y, (p.p % 8)::INTEGER AS x
  FROM plane p JOIN channel k ON k.image_id = p.image_id AND k.c = p.c
  WHERE p.px::FLOAT / 255::FLOAT > 0.5::FLOAT)""",
        _runs("run", "hot", "image_id, instance_id"),
        select="SELECT * FROM run",
    ),
    "result_pairs": _query(
        _det("vec_id // 4", "list_max(embedding) >= 0.35::FLOAT"), FRAMES,
        select="""SELECT image_id, 'frames/frame_' || image_id || '.bmp' AS original_path,
  CASE WHEN image_id IN (SELECT image_id FROM det)
       THEN 'frames/frame_' || image_id || '_overlay.jpg' END AS result_path FROM frame""",
    ),
    "image_scan": _query(
        FRAMES, GRID,
        select="""SELECT 'frame_' || image_id || '.bmp' AS file, height, width, 3 AS n_channels,
  sum((image_id * 31 + y * 7 + x * 3 + c * 11) % 256)::BIGINT AS byte_sum
  FROM grid, unnest([0, 1, 2]) AS k(c) GROUP BY image_id, height, width""",
    ),
    "decoded_scan": _query(
        FRAMES, GRID,
        """summed AS (
  SELECT image_id, sum((image_id * 31 + y * 7 + x * 3 + c * 11) % 256)::BIGINT AS byte_sum
  FROM grid, unnest([0, 1, 2]) AS k(c) GROUP BY image_id),
told AS (
  SELECT *, CASE WHEN image_id % 2 = 0 THEN NULL WHEN image_id % 7 = 5 THEN 'image could not be decoded'
    WHEN image_id % 7 = 3 THEN 'raw: more than 1048576 bytes of pixels' END AS decode_error FROM frame)""",
        select="""SELECT 'frame_' || image_id || CASE WHEN image_id % 2 = 0 THEN '.tiff' ELSE '.webp' END AS file,
  CASE WHEN decode_error IS NULL THEN height END AS height, CASE WHEN decode_error IS NULL THEN width END AS width,
  CASE WHEN decode_error IS NULL THEN 3 END AS n_channels,
  CASE WHEN decode_error IS NULL THEN byte_sum END AS byte_sum, decode_error
  FROM told JOIN summed USING (image_id)""",
    ),
    "stream_ingest": _query(
        FRAMES,
        select="SELECT 'frame_' || image_id || '.bmp' AS file, height, width, NULL::VARCHAR AS error FROM frame",
    ),
}
