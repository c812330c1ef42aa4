"""DuckDB SQL that computes the registered queries independently.

Shared sub-queries are named fragments; ``_sql`` puts the ones a query needs in front.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}


def _fragment(name: str, body: str, *needs: str) -> None:
    FRAGMENTS[name] = (needs, body)


def _sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in FRAGMENTS[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    with_ = ",\n".join(f"{name} AS ({FRAGMENTS[name][1]})" for name in order)
    return f"WITH {with_}\n{body}" if order else body


def digest(*parts: str, digits: int = 8) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, {digits})) AS BIGINT)"


_fragment(
    "li",
    """
    SELECT *, cents // qty AS unit FROM (
      SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln,
             CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
             CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
             l_returnflag AS rf, l_linestatus AS ls,
             CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day
      FROM lineitem)
    """,
)
_fragment(
    "prices",
    """
    SELECT li.pk, CAST(sum(unit) AS BIGINT) // count(*) AS avg24h,
           min(unit) FILTER (WHERE day = last_day) AS low, max(unit) // 12 AS vendor
    FROM li JOIN (SELECT pk, max(day) AS last_day FROM li GROUP BY pk) d ON li.pk = d.pk
    GROUP BY li.pk
    """,
    "li",
)
_fragment(
    "catalog",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name,
           CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_brand END AS short,
           CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 1 + p_size % 3 END AS width,
           CASE WHEN p_partkey % 29 <> 0 THEN 1 + (p_size // 3) % 2 END AS height,
           CASE WHEN p_partkey % 7 <> 0 THEN avg24h END AS avg24h,
           CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE low END AS low,
           CASE WHEN p_partkey % 5 <> 0 THEN vendor END AS vendor,
           CAST(round(p_retailprice * 100) AS BIGINT) * (1 + p_size % 7) AS base,
           p_partkey AS pos
    FROM part LEFT JOIN prices ON pk = p_partkey
    """,
    "prices",
)
_fragment(
    "names",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name,
           CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_brand END AS short, p_partkey AS pos
    FROM part
    """,
)


def _items(basis: str) -> str:
    flea = (
        "CASE WHEN coalesce(low, 0) <> 0 THEN low ELSE coalesce(avg24h, 0) END"
        if basis == "low"
        else "CASE WHEN coalesce(avg24h, 0) <> 0 THEN avg24h ELSE coalesce(low, 0) END"
    )
    return f"""
    SELECT item_id, name, short, CASE WHEN coalesce(width, 0) = 0 THEN 1 ELSE width END AS width,
           CASE WHEN coalesce(height, 0) = 0 THEN 1 ELSE height END AS height,
           CAST(greatest({flea}, coalesce(vendor, 0), coalesce(base, 0)) AS BIGINT) AS value
    FROM catalog
    """


INDEX = "((((day * 16 + tax) * 16 + disc) * 64 + qty) * 8 + ln) * 16777216 + cents"

_fragment("items", _items("avg24h"), "catalog")
_fragment("items_low", _items("low"), "catalog")
_fragment(
    "detections",
    f"""
    SELECT CAST(ok AS VARCHAR) AS session_id,
           {INDEX} AS det_idx,
           CAST(pk AS VARCHAR) AS icon_id,
           (qty * 37 + ln * 211) % 1700 AS x0, (disc * 91 + tax * 53 + ln * 67) % 900 AS y0,
           (qty * 37 + ln * 211) % 1700 + 64 + pk % 3 * 63 AS x1,
           (disc * 91 + tax * 53 + ln * 67) % 900 + 64 + (pk // 3) % 2 * 63 AS y1,
           CAST(1000 - tax * 95 AS DOUBLE) / 1000 AS det_conf,
           CASE WHEN sk % 4 = 0 THEN '' WHEN sk % 11 = 0 THEN 'gone-' || sk
                WHEN ln % 3 = 0 THEN CAST(pk AS VARCHAR) ELSE CAST(sk AS VARCHAR) END AS ocr_id,
           CASE WHEN sk % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(100 - disc * 7 AS DOUBLE) / 100 END AS ocr_score,
           rf || '-' || ln AS ocr_raw, qty AS quantity
    FROM li
    """,
    "li",
)
_fragment(
    "auto",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS icon_id,
           CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'gone-' || p_partkey
                ELSE CAST(p_partkey AS VARCHAR) END AS item_id,
           CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS name,
           CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS short,
           CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size * 8 + p_partkey % 10 AS DOUBLE) / 10 END AS score,
           CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 19 <> 0 THEN CAST(p_partkey * 7 % 80 AS DOUBLE) / 10 END AS margin
    FROM part
    """,
)
_fragment(
    "flat",
    """
    SELECT CAST(s_suppkey * 17 AS VARCHAR) AS icon_id,
           CASE WHEN s_acctbal > 7000 THEN 'unknown-' || s_suppkey ELSE CAST(s_suppkey + 1 AS VARCHAR) END AS item_id
    FROM supplier
    """,
)
_fragment(
    "events_k",
    "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
_fragment(
    "link_events",
    """
    SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS icon_id, CASE WHEN k % 10 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS item_id,
           CASE WHEN event_type = 'purchase' THEN 'manual' ELSE 'visual' END AS source
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
    """,
)
_fragment(
    "manual",
    """
    SELECT icon_id, item_id, seq FROM (
      SELECT CAST(user_id AS VARCHAR) AS icon_id, CAST(k AS VARCHAR) AS item_id, event_id AS seq,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
      FROM events_k WHERE event_type = 'purchase' AND k % 10 <> 0)
    WHERE rn = 1
    """,
    "events_k",
)
_fragment(
    "linkmap",
    """
    SELECT icon_id, item_id, score, margin, layer > 0 AS override FROM (
      SELECT *, row_number() OVER (PARTITION BY icon_id ORDER BY layer DESC) AS rn FROM (
        SELECT icon_id, item_id, score, margin, 0 AS layer FROM auto WHERE item_id IS NOT NULL
        UNION ALL SELECT icon_id, item_id, NULL, NULL, 1 FROM flat
        UNION ALL SELECT icon_id, item_id, NULL, NULL, 2 FROM manual))
    WHERE rn = 1
    """,
    "auto",
    "flat",
    "manual",
)
CERTAINTY = """
    CASE WHEN {override} THEN 1.0::DOUBLE
         WHEN score IS NULL OR margin IS NULL THEN 0.5::DOUBLE
         ELSE CAST(printf('%.3f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, margin / 5.0::DOUBLE))
              * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (40.0::DOUBLE - score) / 28.0::DOUBLE))) AS DOUBLE) END
"""
_fragment("certain", f"SELECT *, {CERTAINTY.format(override='override')} AS certainty FROM linkmap", "linkmap")


def _records(items: str) -> str:
    return f"""
    SELECT j.*, width * height AS slots,
           CAST(round_even(CAST(value AS DOUBLE) / (width * height), 0) AS BIGINT) AS per_slot
    FROM (
      SELECT d.*, v.item_id AS v_id, c.score AS v_score, c.margin AS v_margin, c.override AS v_override,
             CASE WHEN v.item_id IS NOT NULL THEN c.certainty END AS v_cert,
             o.item_id AS o_id, o.width AS o_width,
             CASE WHEN {{seen}} THEN CASE WHEN c.override THEN 'override' ELSE 'yolo' END
                  WHEN o.item_id IS NOT NULL THEN 'ocr' END AS source,
             CASE WHEN {{seen}} THEN c.certainty WHEN o.item_id IS NOT NULL THEN ocr_score ELSE 0.0::DOUBLE END AS certainty,
             coalesce(v.item_id = o.item_id, false) AS agree,
             CASE WHEN {{seen}} THEN v.item_id ELSE o.item_id END AS id,
             CASE WHEN {{seen}} THEN v.name ELSE o.name END AS name,
             CASE WHEN {{seen}} THEN v.short ELSE o.short END AS short,
             CASE WHEN {{seen}} THEN v.width ELSE o.width END AS width,
             CASE WHEN {{seen}} THEN v.height ELSE o.height END AS height,
             CASE WHEN {{seen}} THEN v.value ELSE o.value END AS value
      FROM detections d
      LEFT JOIN certain c ON d.icon_id = c.icon_id
      LEFT JOIN {items} v ON c.item_id = v.item_id
      LEFT JOIN {items} o ON d.ocr_id = o.item_id) j
    """.format(seen="(v.item_id IS NOT NULL AND (o.item_id IS NULL OR c.certainty >= ocr_score))")


_fragment("records", _records("items"), "detections", "certain", "items")
_fragment("records_low", _records("items_low"), "detections", "certain", "items_low")

# --- session results ---------------------------------------------------------------------

_fragment(
    "collapsed",
    """
    SELECT session_id, id, any_value(name) AS name, any_value(short) AS short, any_value(width) AS width,
           any_value(height) AS height, any_value(value) AS value, any_value(slots) AS slots,
           any_value(per_slot) AS per_slot, count(*) AS qty, min(det_idx) AS first_det,
           arg_min(icon_id, det_idx) AS first_icon, arg_min(x0, det_idx) AS first_x0
    FROM records WHERE source IS NOT NULL GROUP BY session_id, id
    """,
    "records",
)
ORACLE["keep_ditch"] = _sql(
    """
    SELECT session_id, id, name, short, width, height, value, slots, per_slot, qty, first_det,
           CASE WHEN rn <= ceil(n / 2.0) THEN 'keep' ELSE 'ditch' END AS list,
           CASE WHEN rn <= ceil(n / 2.0) THEN rn ELSE n - rn + 1 END AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY per_slot DESC, first_det) AS rn,
                 count(*) OVER (PARTITION BY session_id) AS n FROM collapsed)
    """,
    "collapsed",
)
ORACLE["rank_by_slot"] = _sql(
    """
    SELECT session_id, det_idx, id, per_slot,
           row_number() OVER (PARTITION BY session_id ORDER BY per_slot DESC, det_idx) AS position
    FROM records WHERE source IS NOT NULL
    """,
    "records",
)


def _summary(records: str) -> str:
    return f"""
    SELECT session_id, count(*) AS detections, count(source) AS identified,
           CAST(coalesce(sum(value), 0) AS BIGINT) AS total,
           count(*) FILTER (WHERE source = 'yolo') AS by_yolo,
           count(*) FILTER (WHERE source = 'ocr') AS by_ocr,
           count(*) FILTER (WHERE source = 'override') AS by_override
    FROM {records} GROUP BY session_id
    """


ORACLE["session_summary"] = _sql(_summary("records"), "records")
ORACLE["session_summary_low"] = _sql(_summary("records_low"), "records_low")
ORACLE["reprojection"] = ORACLE["session_summary_low"]
ORACLE["collapse_qty"] = _sql(
    "SELECT session_id, id, name, per_slot, value, qty, first_det, first_icon, first_x0 FROM collapsed", "collapsed"
)
ORACLE["least_certain"] = _sql(
    """
    SELECT session_id, det_idx, certainty, source,
           row_number() OVER (PARTITION BY session_id ORDER BY certainty, det_idx) AS position
    FROM records
    """,
    "records",
)
ORACLE["top_report"] = _sql(
    """
    SELECT session_id, det_idx, CASE WHEN short = '' THEN name ELSE short END AS label, source, slots, per_slot, value
    FROM records WHERE source IS NOT NULL ORDER BY per_slot DESC, session_id, det_idx LIMIT 25
    """,
    "records",
)
ORACLE["stack_totals"] = _sql(
    """
    SELECT session_id, id, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM records WHERE source IS NOT NULL GROUP BY session_id, id
    """,
    "records",
)
ORACLE["slot_labels"] = _sql(
    """
    SELECT session_id, det_idx,
           CASE WHEN short = '' THEN name ELSE short END || ' ' || format('{:,}', per_slot) || '/sl' AS label
    FROM records WHERE source IS NOT NULL
    """,
    "records",
)

# --- identity ----------------------------------------------------------------------------

ORACLE["resolve_identity"] = _sql(
    """
    SELECT session_id, det_idx, icon_id, source, certainty, agree, id, name, short, width, height, value, slots, per_slot
    FROM records
    """,
    "records",
)
ORACLE["resolve_nested"] = _sql(
    """
    SELECT session_id, det_idx, v_id AS yolo_id, CASE WHEN v_id IS NOT NULL THEN v_score END AS yolo_score,
           CASE WHEN v_id IS NOT NULL THEN v_margin END AS yolo_margin,
           CASE WHEN v_id IS NOT NULL THEN v_override END AS yolo_override, v_cert AS yolo_certainty,
           coalesce(o_id, '') AS text_id, o_width AS text_width, ocr_score AS text_score, ocr_raw AS text_raw
    FROM records
    """,
    "records",
)
ORACLE["identity_agreement"] = _sql("SELECT source, agree, count(*) AS n FROM records GROUP BY source, agree", "records")
ORACLE["unidentified"] = _sql(
    "SELECT session_id, det_idx, icon_id, certainty FROM records WHERE source IS NULL", "records"
)
ORACLE["all_records"] = _sql("SELECT session_id, det_idx, source, value FROM records", "records")
ORACLE["detections_roundtrip"] = _sql(
    """
    SELECT session_id, det_idx, icon_id, det_conf, coalesce(o_id, '') AS ocr_id, ocr_score, ocr_raw,
           x0 AS b0, y0 AS b1, x1 AS b2, y1 AS b3
    FROM records
    """,
    "records",
)
ORACLE["confident_detections"] = _sql(
    "SELECT session_id, det_idx, det_conf FROM detections WHERE det_conf >= 0.4::DOUBLE", "detections"
)
ORACLE["capped_detections"] = _sql(
    f"""
    SELECT session_id, det_conf, det_idx FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY det_conf DESC, det_idx) AS rn FROM (
        SELECT CAST(sk AS VARCHAR) AS session_id, CAST(1000 - tax * 95 AS DOUBLE) / 1000 AS det_conf,
               {INDEX} AS det_idx FROM li))
    WHERE rn <= 400
    """,
    "li",
)
ORACLE["detection_overflow"] = _sql(
    "SELECT CAST(sk AS VARCHAR) AS session_id, count(*) AS detections, count(*) - 400 AS over FROM li GROUP BY sk HAVING count(*) > 400", "li"
)
ORACLE["raw_detections"] = _sql(
    f"""
    SELECT session_id, det_idx, icon_id, CAST(round_even(CAST(cents % 9001 AS DOUBLE) / 8, 0) AS INTEGER) AS x0,
           CAST(round_even(CAST(cents % 7001 AS DOUBLE) / 8, 0) AS INTEGER) AS y0, CAST(printf('%.3f', conf) AS DOUBLE) AS det_conf,
           CAST(printf('%.2f', CAST(cents % 81 AS DOUBLE) / 80) AS DOUBLE) AS ocr_score
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY conf DESC, det_idx) AS rn
          FROM (SELECT *, CAST(ok AS VARCHAR) AS session_id, CAST(pk AS VARCHAR) AS icon_id, {INDEX} AS det_idx,
                       CAST(cents % 100003 AS DOUBLE) / 100003 AS conf FROM li)
          WHERE conf >= 0.25::DOUBLE) WHERE rn <= 400
    """,
    "li",
)
ORACLE["session_listing"] = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS session_id FROM lineitem"
ORACLE["session_replay"] = _sql(
    """
    SELECT session_id, det_idx, icon_id, det_conf, ocr_id, ocr_score FROM detections
    WHERE session_id = (SELECT max(session_id) FROM detections)
    """,
    "detections",
)

# --- prices ------------------------------------------------------------------------------


def _values(items: str) -> str:
    return f"""
    SELECT item_id, short, width, height, value,
           CAST(round_even(CAST(value AS DOUBLE) / (width * height), 0) AS BIGINT) AS per_slot
    FROM {items}
    """


ORACLE["effective_value_avg"] = _sql(_values("items"), "items")
ORACLE["effective_value_low"] = _sql(_values("items_low"), "items_low")
ORACLE["effective_value_default"] = ORACLE["effective_value_avg"]
COPIED = "CASE WHEN coalesce(avg24h, 0) <> 0 THEN avg24h WHEN coalesce(low, 0) <> 0 THEN low ELSE base END"
ORACLE["fallback_price"] = _sql(
    f"SELECT item_id, coalesce({COPIED}, 0) AS price, {COPIED} AS copied FROM catalog", "catalog"
)
ORACLE["best_vendor"] = """
    SELECT p.p_partkey,
           CAST(CASE WHEN p_size % 5 <> 0 THEN
             (SELECT coalesce(max(p.p_partkey * i * 7919 % 10007), 0) FROM range(2, 6) r(i) WHERE i <= p.p_size % 4 + 1)
           ELSE 0 END AS BIGINT) AS vendor
    FROM part p
"""

# --- links -------------------------------------------------------------------------------

ORACLE["link_projection"] = _sql(
    "SELECT icon_id, item_id, score, margin, override, certainty FROM certain", "certain"
)
ORACLE["link_latest_event"] = _sql("SELECT icon_id, item_id, seq FROM manual", "manual")
ORACLE["link_certainty"] = _sql(
    f"SELECT icon_id, score, margin, {CERTAINTY.format(override='false')} AS certainty FROM auto", "auto"
)
_fragment(
    "effective",
    f"""
    SELECT coalesce(a.icon_id, f.icon_id) AS icon_id,
           CASE WHEN f.icon_id IS NOT NULL THEN f.item_id ELSE a.item_id END AS item_id,
           CASE WHEN f.icon_id IS NOT NULL THEN coalesce(k.name, '(unknown id)') ELSE a.name END AS name,
           CASE WHEN f.icon_id IS NOT NULL THEN k.short ELSE a.short END AS short,
           CASE WHEN f.icon_id IS NOT NULL THEN k.copied WHEN a.item_id IS NOT NULL THEN p.copied END AS price,
           CASE WHEN f.icon_id IS NULL THEN a.score END AS score,
           CASE WHEN f.icon_id IS NULL THEN a.margin END AS margin,
           CASE WHEN f.icon_id IS NOT NULL THEN 'override' ELSE 'auto' END AS source
    FROM auto a FULL JOIN flat f ON a.icon_id = f.icon_id
    LEFT JOIN (SELECT *, {COPIED} AS copied FROM catalog) k ON f.item_id = k.item_id
    LEFT JOIN (SELECT *, {COPIED} AS copied FROM catalog) p ON a.icon_id = p.item_id
    """,
    "auto",
    "flat",
    "catalog",
)
ORACLE["effective_map"] = _sql("SELECT * FROM effective", "effective")
_fragment(
    "doubtful",
    """
    SELECT icon_id, name, source,
           CASE WHEN source = 'override' THEN -1e9::DOUBLE
                ELSE coalesce(score, 0.0::DOUBLE) - coalesce(margin, 0.0::DOUBLE) END AS doubt
    FROM effective
    """,
    "effective",
)
for _mode, _order in {
    "worst": "doubt DESC, icon_id",
    "best": "doubt, icon_id",
    "random": f"{digest("'7'", 'icon_id', digits=15)}, icon_id",
}.items():
    ORACLE[f"review_{_mode}"] = _sql(f"SELECT * FROM doubtful ORDER BY {_order} LIMIT 400", "doubtful")
ORACLE["near_tie_links"] = _sql("SELECT icon_id, score, margin FROM auto WHERE margin < 5", "auto")
_fragment(
    "searches",
    """
    SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN upper(substr(p_name, 1, 9))
                                       WHEN 2 THEN substr(p_name, 3, 2) WHEN 3 THEN substr(p_name, 2, 1) ELSE lower(p_type) END AS query
    FROM part
    """,
)
_fragment("hits", "SELECT query, item_id, name, pos FROM names JOIN searches ON contains(lower(name), lower(query))", "names", "searches")
ORACLE["find_asked"] = _sql("SELECT query, count(*) AS hits, min(pos) AS first_pos FROM hits GROUP BY query", "hits")
ORACLE["unique_match"] = _sql(
    """
    SELECT a.query, CASE WHEN x.item_id IS NOT NULL THEN 'id' WHEN coalesce(h.hits, 0) = 0 THEN 'none'
                         WHEN h.hits = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
           CASE WHEN x.item_id IS NOT NULL THEN 1 ELSE coalesce(h.hits, 0) END AS hits,
           coalesce(x.item_id, f.item_id) AS item_id, coalesce(x.name, f.name) AS name
    FROM searches a LEFT JOIN names x ON x.item_id = a.query
    LEFT JOIN (SELECT query, count(*) AS hits FROM hits GROUP BY query) h ON h.query = a.query
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, item_id) AS rn FROM hits) WHERE rn <= 15) f
      ON f.query = a.query AND x.item_id IS NULL
    """,
    "hits",
)
ORACLE["find_items"] = _sql(
    """
    SELECT item_id, name, query FROM names JOIN (VALUES ('Gold'), ('bolt')) q(query)
    ON contains(lower(name), lower(query))
    """,
    "names",
)
ORACLE["search_items"] = _sql(
    """
    SELECT item_id, name, short, width, height, value FROM items
    WHERE contains(lower(name), 'red') OR contains(lower(short), 'red')
    ORDER BY NOT starts_with(lower(short), 'red'), NOT starts_with(lower(name), 'red'), length(name), CAST(item_id AS BIGINT) LIMIT 25
    """,
    "items",
)
_fragment(
    "evidence",
    """
    SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS icon_id, CAST(k % 20 AS VARCHAR) AS item_id,
           CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'manual' WHEN event_type = 'view' THEN 'hash'
                WHEN event_type = 'signup' THEN 'api_match' ELSE 'visual' END AS source,
           event_id * 7 % 101 AS certainty
    FROM events_k
    """,
    "events_k",
)
ORACLE["evidence_fusion"] = _sql(
    """
    SELECT coalesce(b.icon_id, m.icon_id) AS icon_id, coalesce(m.item_id, b.item_id) AS item_id,
           CASE WHEN m.icon_id IS NOT NULL THEN 1.0::DOUBLE ELSE b.score END AS score,
           CASE WHEN m.icon_id IS NOT NULL THEN 0 ELSE b.sources END AS sources,
           m.icon_id IS NULL AND coalesce(round_even(b.score - b.second, 6) < 0.05::DOUBLE, false) AS conflict
    FROM (SELECT * FROM (
            SELECT icon_id, item_id, score, sources,
                   lead(score) OVER (PARTITION BY icon_id ORDER BY score DESC, item_id) AS second,
                   row_number() OVER (PARTITION BY icon_id ORDER BY score DESC, item_id) AS rn
            FROM (SELECT icon_id, item_id, count(*) AS sources,
                         round_even(1 - product(1 - CASE source WHEN 'api_match' THEN 0.9::DOUBLE WHEN 'hash' THEN 0.8::DOUBLE
                                                    WHEN 'visual' THEN 0.6::DOUBLE END * certainty / 100), 6) AS score
                  FROM (SELECT icon_id, item_id, source, max(certainty) AS certainty FROM evidence
                        WHERE source <> 'manual' GROUP BY ALL)
                  GROUP BY icon_id, item_id)) WHERE rn = 1) b
    FULL JOIN (SELECT icon_id, arg_max(item_id, seq) AS item_id FROM evidence WHERE source = 'manual' GROUP BY icon_id) m
      ON b.icon_id = m.icon_id
    """,
    "evidence",
)
ORACLE["majority_vote"] = _sql(
    """
    SELECT icon_id, name, votes FROM (
      SELECT *, row_number() OVER (PARTITION BY icon_id ORDER BY votes DESC, name) AS rn
      FROM (SELECT icon_id, ocr_id AS name, count(*) AS votes FROM detections WHERE ocr_id <> '' GROUP BY ALL))
    WHERE rn = 1
    """,
    "detections",
)

# --- matching ----------------------------------------------------------------------------

_fragment(
    "vectors",
    """
    SELECT vec_id AS icon_id, label AS block, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 255) AS vec
    FROM embeddings
    """,
)
_fragment(
    "images",
    """
    SELECT icon_id AS item_id, block, list_transform(vec, lambda v: round_even(v / 24, 0) * 24) AS vec FROM vectors
    """,
    "vectors",
)
_fragment(
    "ranked",
    """
    SELECT * FROM (
      SELECT icon_id, item_id, distance, row_number() OVER (PARTITION BY icon_id ORDER BY distance, item_id) AS rank
      FROM (SELECT q.icon_id, c.item_id,
                   sqrt(list_sum(list_transform(range(1, 65), lambda i:
                          CASE WHEN abs(q.vec[i]) > 16 THEN (q.vec[i] - c.vec[i]) * (q.vec[i] - c.vec[i]) ELSE 0.0::DOUBLE END))
                        / len(list_filter(q.vec, lambda v: abs(v) > 16))) AS distance
            FROM vectors q JOIN images c ON q.block = c.block
            WHERE len(list_filter(q.vec, lambda v: abs(v) > 16)) > 0)) WHERE rank <= 3
    """,
    "vectors",
    "images",
)
ORACLE["topk_match"] = _sql("SELECT icon_id, item_id, rank, round_even(distance, 4) AS distance FROM ranked", "ranked")
_fragment(
    "matches",
    """
    SELECT v.icon_id, v.block, m.item_id, m.name, m.score, m.margin, m.alts
    FROM vectors v LEFT JOIN (
      SELECT icon_id, max(item_id) FILTER (WHERE rank = 1) AS item_id,
             'item ' || max(item_id) FILTER (WHERE rank = 1) AS name,
             round_even(max(distance) FILTER (WHERE rank = 1), 1) AS score,
             round_even(max(distance) FILTER (WHERE rank = 2) - max(distance) FILTER (WHERE rank = 1), 1) AS margin,
             coalesce(string_agg('item ' || item_id, ';' ORDER BY rank) FILTER (WHERE rank > 1), '') AS alts
      FROM ranked GROUP BY icon_id) m ON v.icon_id = m.icon_id
    """,
    "ranked",
    "vectors",
)
ORACLE["match_table"] = _sql("SELECT * FROM matches", "matches")
ORACLE["match_quality"] = _sql(
    """
    SELECT count(*) AS icons, round_even(quantile_cont(score, 0.5), 4) AS score_median,
           round_even(quantile_cont(score, 0.9), 4) AS score_p90,
           round_even(quantile_cont(margin, 0.5), 4) AS margin_median,
           count(*) FILTER (WHERE margin < 5) AS near_ties
    FROM matches WHERE score IS NOT NULL
    """,
    "matches",
)
ORACLE["block_counts"] = "SELECT label AS block, count(*) AS candidates FROM embeddings GROUP BY label"
_fragment("short_index", "SELECT lower(short) AS key, arg_min(item_id, pos) AS item_id FROM names WHERE short <> '' GROUP BY 1", "names")
_fragment("full_index", "SELECT lower(name) AS key, arg_min(item_id, pos) AS item_id FROM names WHERE name <> '' GROUP BY 1", "names")
ORACLE["name_index"] = _sql(
    "SELECT 'short' AS kind, * FROM short_index UNION ALL SELECT 'full', * FROM full_index", "short_index", "full_index"
)
ORACLE["normalised_text"] = f"""
    SELECT conv_id, turn, sha1(clean) AS digest, length(clean) AS chars
    FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS clean
          FROM conversations)
"""
TYPED = """
    CASE p_partkey % 3 WHEN 0 THEN p_name
         WHEN 1 THEN substr(p_name, 1, 2 + p_partkey % 4) || substr(p_name, 4 + p_partkey % 4)
         ELSE ' ' || replace(upper(p_name), ' ', chr(160) || ' ') END
"""
_fragment("texts", f"SELECT DISTINCT trim(regexp_replace(lower({TYPED}), '[\\s\\x{{A0}}]+', ' ', 'g')) AS text FROM part")
ORACLE["name_match_exact"] = _sql(
    """
    SELECT text, coalesce(s.item_id, f.item_id) AS item_id,
           CASE WHEN s.item_id IS NOT NULL THEN 'short' WHEN f.item_id IS NOT NULL THEN 'full' END AS stage
    FROM texts LEFT JOIN short_index s ON s.key = text LEFT JOIN full_index f ON f.key = text
    """,
    "texts",
    "short_index",
    "full_index",
)
# Longest common block of two texts as one number: length * 1000 + (999 - start in a).
BLOCK = """
    coalesce(list_max(list_transform(range(1, length(a) + 1), lambda i:
      coalesce(list_max(list_filter(range(1, length(a) - i + 2), lambda k: contains(b, substr(a, CAST(i AS INTEGER), CAST(k AS INTEGER))))), 0)
      * 1000 + 999 - i)), 0)
"""


def _ratios(name: str, pairs: str) -> str:
    """Matching-block ratio of all ``(a0, b0)`` of a query: take the longest block, go on left and right of it."""
    return f"""
    {name}_seg(a0, b0, a, b, block) AS (
      SELECT a0, b0, a, b, {BLOCK} FROM (SELECT a0, b0, a0 AS a, b0 AS b FROM ({pairs}))
      UNION ALL
      SELECT a0, b0, a, b, {BLOCK} FROM (
        SELECT a0, b0, part.a AS a, part.b AS b FROM (
          SELECT a0, b0, unnest([
              {{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS part
          FROM (SELECT *, instr(b, substr(a, i, k)) AS j FROM (
                  SELECT *, CAST(block // 1000 AS INTEGER) AS k, CAST(999 - block % 1000 AS INTEGER) AS i
                  FROM {name}_seg WHERE block >= 1000)))
        WHERE part.a <> '' AND part.b <> '')),
    {name} AS (SELECT a0, b0, 2.0::DOUBLE * CAST(sum(block // 1000) AS DOUBLE) / (length(a0) + length(b0)) AS ratio
               FROM {name}_seg GROUP BY a0, b0)
    """


def _matched(texts: str, *needs: str) -> str:
    """CTEs up to ``matched(text, item_id, stage, score)``."""
    bound = "2.0 * least(length(key), length(text)) / (length(key) + length(text)) >= 0.6"
    base = _sql("", "short_index", "full_index", *needs).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{base},
    asked AS ({texts}),
    exact AS (SELECT text, coalesce(s.item_id, f.item_id) AS item_id,
                     CASE WHEN s.item_id IS NOT NULL THEN 'short' WHEN f.item_id IS NOT NULL THEN 'full' END AS stage
              FROM asked LEFT JOIN short_index s ON s.key = text LEFT JOIN full_index f ON f.key = text),
    offered AS (SELECT 0 AS later, * FROM short_index UNION ALL SELECT 1, * FROM full_index),
    {_ratios("ratio", f"SELECT DISTINCT key AS a0, text AS b0 FROM exact JOIN offered ON exact.item_id IS NULL AND {bound}")},
    chosen AS (SELECT * FROM (
      SELECT b0 AS text, key, o.item_id, later,
             row_number() OVER (PARTITION BY b0 ORDER BY later, ratio DESC, key DESC) AS rn
      FROM ratio JOIN offered o ON key = a0 WHERE ratio >= 0.6::DOUBLE) WHERE rn = 1),
    {_ratios("told", "SELECT text AS a0, key AS b0 FROM chosen")},
    matched AS (
      SELECT e.text, coalesce(e.item_id, c.item_id) AS item_id,
             coalesce(e.stage, CASE c.later WHEN 0 THEN 'fuzzy_short' WHEN 1 THEN 'fuzzy_full' END) AS stage,
             CASE WHEN e.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(t.ratio, 0.0::DOUBLE) END AS score
      FROM exact e LEFT JOIN chosen c ON c.text = e.text LEFT JOIN told t ON t.a0 = c.text AND t.b0 = c.key)
    """


ORACLE["name_match_fuzzy"] = _matched("SELECT text FROM texts", "texts") + "SELECT * FROM matched"

_fragment(
    "words",
    f"""
    SELECT p_partkey AS box_id, i AS word_idx, parts[i + 1] AS text, i * 40 % 70 AS x,
           i = len(parts) - 1 AS below, len(parts) AS n
    FROM (SELECT p_partkey, list_append(string_split(trim({TYPED}), ' '), p_type) AS parts FROM part),
         LATERAL (SELECT unnest(range(0, len(parts))) AS i)
    """,
)
_fragment(
    "box_texts",
    """
    SELECT box_id, coalesce(string_agg(text, ' ' ORDER BY x, word_idx) FILTER (WHERE NOT below), '') AS top_text,
           string_agg(text, ' ' ORDER BY x, word_idx) AS all_text, string_agg(text, ' ' ORDER BY word_idx) AS raw_text
    FROM words GROUP BY box_id
    """,
    "words",
)
_fragment(
    "box_keys",
    "SELECT *, trim(regexp_replace(lower(top_text), '[\\s\\x{A0}]+', ' ', 'g')) AS top_key, "
    "trim(regexp_replace(lower(all_text), '[\\s\\x{A0}]+', ' ', 'g')) AS all_key FROM box_texts",
    "box_texts",
)
ORACLE["box_text"] = _sql("SELECT * FROM box_texts", "box_texts")
ORACLE["text_in_box"] = (
    _matched("SELECT top_key AS text FROM box_keys WHERE top_key <> '' UNION SELECT all_key FROM box_keys WHERE all_key <> ''", "box_keys")
    + """
    SELECT box_id, coalesce(t.item_id, a.item_id, '') AS ocr_id,
           CAST(printf('%.2f', coalesce(t.score, a.score, 0.0::DOUBLE)) AS DOUBLE) AS ocr_score,
           CASE WHEN t.item_id IS NOT NULL THEN top_text WHEN a.item_id IS NOT NULL THEN all_text ELSE raw_text END AS ocr_raw
    FROM box_keys
    LEFT JOIN (SELECT * FROM matched WHERE item_id IS NOT NULL AND score >= 0.6::DOUBLE) t ON t.text = top_key
    LEFT JOIN (SELECT * FROM matched WHERE item_id IS NOT NULL AND score >= 0.6::DOUBLE) a ON a.text = all_key
    """
)
ORACLE["rescaled_words"] = _sql(
    """
    SELECT box_id, word_idx, round_even(CAST(x AS DOUBLE) / 6, 4) AS x,
           round_even(CASE WHEN below THEN 50.0::DOUBLE ELSE 2.0::DOUBLE END / 6, 4) AS y,
           round_even(30.0::DOUBLE / 6, 4) AS w, round_even(10.0::DOUBLE / 6, 4) AS h
    FROM words
    """,
    "words",
)

# --- duplicates --------------------------------------------------------------------------

_fragment("docs", "SELECT doc_id AS icon_id, lang AS block, sha1(text) AS sig FROM documents")
_fragment(
    "exact_members",
    """
    SELECT icon_id, root FROM (
      SELECT icon_id, min(icon_id) OVER (PARTITION BY block, sig) AS root,
             count(*) OVER (PARTITION BY block, sig) AS n FROM docs) WHERE n > 1
    """,
    "docs",
)
ORACLE["exact_dups"] = _sql(
    "SELECT block, sig, min(icon_id) AS rep, count(*) AS copies FROM docs GROUP BY block, sig HAVING count(*) > 1", "docs"
)
ORACLE["exact_dup_members"] = _sql("SELECT * FROM exact_members", "exact_members")
ORACLE["dup_groups"] = _sql(
    """
    SELECT icon_id, root, group_idx, size FROM exact_members JOIN (
      SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS group_idx
      FROM exact_members GROUP BY root) USING (root)
    """,
    "exact_members",
)


def word(bit: str, start: int, size: int) -> str:
    return (
        f"CAST(list_sum(list_transform(range(0, {size}), lambda i: CASE WHEN {bit.format(i=f'(i + {start + 1})')} "
        "THEN CAST(1 AS BIGINT) << CAST(i AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)"
    )


_fragment("vec_mean", "SELECT *, list_sum(vec) / 64 AS mean FROM vectors", "vectors")
ORACLE["average_hash"] = _sql(
    f"SELECT icon_id, {word('vec[{i}] > mean', 0, 32)} AS w0, {word('vec[{i}] > mean', 32, 32)} AS w1 FROM vec_mean",
    "vec_mean",
)
RISING = "vec[{i} + 1] > vec[{i}]"
ORACLE["gradient_hash"] = _sql(
    f"SELECT icon_id, {word(RISING, 0, 32)} AS w0, {word(RISING, 32, 31)} AS w1 FROM vectors", "vectors"
)
_fragment(
    "dct",
    """
    SELECT icon_id, list_transform(range(0, 16), lambda k: list_sum(list_transform(range(0, 64), lambda n:
             vec[n + 1] * cos(pi() * k * (2 * n + 1) / 128.0::DOUBLE)))) AS vec
    FROM vectors
    """,
    "vectors",
)
_fragment("dct_median", "SELECT *, (list_sort(vec)[8] + list_sort(vec)[9]) / 2 AS mean FROM dct", "dct")
ORACLE["dct_hash"] = _sql(f"SELECT icon_id, {word('vec[{i}] > mean', 0, 16)} AS w0 FROM dct_median", "dct_median")
_fragment(
    "rendered",
    """
    SELECT icon_id * 4 + i AS icon_id, block, CASE i WHEN 0 THEN vec WHEN 1 THEN list_transform(vec, lambda v: round_even(v / 6, 0) * 6)
           ELSE list_transform(vec, lambda v: round_even(v / 10, 0) * 10) END AS vec
    FROM vectors, range(3) r(i)
    """,
    "vectors",
)
_fragment("drawn_mean", "SELECT *, list_sum(vec) / 64 AS mean FROM rendered", "rendered")
_fragment(
    "drawn", f"SELECT icon_id, block, {word('vec[{i}] > mean', 0, 32)} AS lo, {word('vec[{i}] > mean', 32, 32)} AS hi FROM drawn_mean", "drawn_mean"
)
_fragment("reps", "SELECT block, lo, hi, min(icon_id) AS rep, count(*) AS copies FROM drawn GROUP BY block, lo, hi", "drawn")
APART = "bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi))"
ORACLE["near_dup_pairs"] = _sql(
    f"""
    SELECT a.block, a.rep AS rep_a, b.rep AS rep_b, {APART} AS distance, a.copies AS copies_a, b.copies AS copies_b
    FROM reps a JOIN reps b ON a.block = b.block AND a.rep < b.rep AND {APART} <= 4
    """,
    "reps",
)


def _members(name: str, table: str, close: str) -> str:
    return f"""
    {name}_reach(icon_id, other) AS (
      SELECT icon_id, icon_id FROM {table}
      UNION
      SELECT r.icon_id, b.icon_id FROM {name}_reach r JOIN {table} a ON r.other = a.icon_id
      JOIN {table} b ON a.block = b.block AND {close}),
    {name} AS (SELECT icon_id, min(other) AS root FROM {name}_reach GROUP BY icon_id HAVING count(*) > 1)
    """


def _recursive(*needs: str) -> str:
    return _sql("", *needs).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ","


ORACLE["near_dup_clusters"] = _recursive("drawn") + _members("near", "drawn", f"{APART} <= 4") + "SELECT icon_id, root FROM near"


def _method(label: str, members: str, table: str) -> str:
    return f"""
    SELECT '{label}' AS method, count(*) AS groups, CAST(coalesce(sum(size), 0) AS BIGINT) AS ambiguous,
           round_even(100 * CAST(coalesce(sum(size), 0) AS DOUBLE) / (SELECT count(*) FROM {table}), 2) AS ambiguous_pct,
           coalesce(max(size), 0) AS biggest, (SELECT count(*) FROM {table}) AS icons
    FROM (SELECT root, count(*) AS size FROM {members} GROUP BY root)
    """


_fragment("gradient", f"SELECT icon_id, block, {word(RISING, 0, 32)} AS lo, {word(RISING, 32, 31)} AS hi FROM rendered", "rendered")
_fragment(
    "drawn_dct",
    """
    SELECT icon_id, block, list_transform(range(0, 16), lambda k: list_sum(list_transform(range(0, 64), lambda n:
             vec[n + 1] * cos(pi() * k * (2 * n + 1) / 128.0::DOUBLE)))) AS vec
    FROM rendered
    """,
    "rendered",
)
_fragment("drawn_median", "SELECT *, (list_sort(vec)[8] + list_sort(vec)[9]) / 2 AS mean FROM drawn_dct", "drawn_dct")
_fragment("waves", f"SELECT icon_id, block, {word('vec[{i}] > mean', 0, 16)} AS lo, 0::BIGINT AS hi FROM drawn_median", "drawn_median")
METHODS = {
    "exact": ("same", "rendered", "a.vec = b.vec"),
    "average-64/d2": ("near2", "drawn", f"{APART} <= 2"),
    "average-64/d4": ("near4", "drawn", f"{APART} <= 4"),
    "dct-16/d1": ("dct1", "waves", f"{APART} <= 1"),
    "gradient-64/d4": ("grad4", "gradient", f"{APART} <= 4"),
}
ORACLE["dup_summary"] = (
    _recursive("drawn", "gradient", "waves")
    + ",".join(_members(*spec) for spec in METHODS.values())
    + " UNION ALL ".join(_method(label, name, table) for label, (name, table, _) in METHODS.items())
)
ORACLE["document_dup_summary"] = _sql(_method("exact", "exact_members", "docs"), "exact_members", "docs")

# --- training-set tables -----------------------------------------------------------------

_fragment(
    "icons",
    """
    SELECT * FROM (
      SELECT p_partkey AS icon_id,
             CAST(greatest(1, round_even((10 + p_size * 13 - 1) / 63.0::DOUBLE, 0)) AS INTEGER) AS cells_w,
             CAST(greatest(1, round_even((40 + p_partkey % 17 * 63 - 1) / 63.0::DOUBLE, 0)) AS INTEGER) AS cells_h
      FROM part) WHERE cells_w BETWEEN 1 AND 10 AND cells_h BETWEEN 1 AND 16
    """,
)
ORACLE["icon_footprints"] = _sql("SELECT * FROM icons", "icons")
_fragment(
    "classed",
    """
    SELECT d.icon_id, coalesce(m.root, d.icon_id) AS canonical, m.root IS NOT NULL AS ambiguous
    FROM docs d LEFT JOIN exact_members m ON d.icon_id = m.icon_id
    """,
    "docs",
    "exact_members",
)
_fragment(
    "vocab",
    """
    SELECT canonical, count(*) AS icons, bool_or(ambiguous) AS ambiguous, row_number() OVER (ORDER BY canonical) - 1 AS class_idx
    FROM classed GROUP BY canonical
    """,
    "classed",
)
ORACLE["canonical_class"] = _sql("SELECT * FROM classed", "classed")
ORACLE["class_vocab"] = _sql("SELECT * FROM vocab", "vocab")
ORACLE["class_members"] = _sql(
    "SELECT class_idx, icon_id, canonical FROM classed JOIN vocab USING (canonical)", "classed", "vocab"
)
ORACLE["class_metadata"] = _sql(
    "SELECT class_idx, CAST(canonical AS VARCHAR) AS name, ambiguous, icons FROM vocab", "vocab"
)
_fragment(
    "queue",
    f"""
    SELECT *, row_number() OVER (ORDER BY {digest("'7'", "icon_id", "copy", digits=15)}, icon_id, copy) - 1 AS position,
           count(*) OVER () AS total
    FROM icons, (SELECT unnest(range(1, 4)) AS copy)
    """,
    "icons",
)
ORACLE["balanced_queue"] = _sql("SELECT icon_id, copy, position FROM queue", "queue")
ORACLE["chunk_queue"] = _sql(
    """
    SELECT position // CAST(ceil(total / 7.0) AS BIGINT) AS chunk, count(*) AS rows, min(position) AS first_position
    FROM queue GROUP BY 1
    """,
    "queue",
)
ORACLE["scene_batches"] = _sql("SELECT icon_id, copy, position // 35 AS scene FROM queue", "queue")
ORACLE["train_val_split"] = _sql(
    f"""
    SELECT scene, CASE WHEN {digest("'7'", "'split'", "scene")} < CAST(floor(0.1 * 4294967296) AS BIGINT) THEN 'val' ELSE 'train' END AS split,
           count(*) AS objects
    FROM (SELECT position // 35 AS scene FROM queue) GROUP BY scene
    """,
    "queue",
)
ORACLE["turned_icons"] = _sql(
    f"""
    SELECT icon_id, copy, turned, CASE WHEN turned THEN cells_h ELSE cells_w END AS cells_w,
           CASE WHEN turned THEN cells_w ELSE cells_h END AS cells_h
    FROM (SELECT *, {digest("'7'", "'turn'", "icon_id", "copy")} < 2147483648 AS turned FROM queue)
    """,
    "queue",
)
ORACLE["sampled_icons"] = _sql(
    f"SELECT * FROM icons ORDER BY {digest("'7'", "icon_id", digits=15)}, icon_id LIMIT 100", "icons"
)
ORACLE["label_rows"] = _sql(
    """
    SELECT session_id, det_idx,
           printf('%d %.6f %.6f %.6f %.6f', CAST(icon_id AS INTEGER), (x0 + (x1 - x0) / 2.0::DOUBLE) / 1920,
                  (y0 + (y1 - y0) / 2.0::DOUBLE) / 1080, CAST(x1 - x0 AS DOUBLE) / 1920, CAST(y1 - y0 AS DOUBLE) / 1080) AS line
    FROM detections
    """,
    "detections",
)
_fragment(
    "grids",
    """
    SELECT s_suppkey AS grid_id, s_nationkey AS scope, CAST(s_suppkey * 173 % 1500 AS DOUBLE) AS x,
           CAST(s_suppkey * 97 % 800 AS DOUBLE) AS y,
           CAST((1 + s_suppkey % 5) * 63 + s_suppkey % 2 AS DOUBLE) AS w,
           CAST((1 + (s_suppkey // 5) % 4) * 63 + s_suppkey % 3 AS DOUBLE) AS h,
           CASE WHEN s_suppkey % 9 <> 0 THEN 1 + s_suppkey % 5 ELSE 1 END AS cols,
           CASE WHEN s_suppkey % 10 <> 0 THEN 1 + (s_suppkey // 5) % 4 ELSE 1 END AS rows
    FROM supplier
    """,
)
_fragment("cells", "SELECT *, w / cols AS cw, h / rows AS ch FROM grids", "grids")
ORACLE["grid_cells"] = _sql(
    "SELECT grid_id, cols, rows, round_even(cw, 6) AS cw, round_even(ch, 6) AS ch FROM cells", "cells"
)
_fragment(
    "spots",
    """
    SELECT cells.*, c.col, r.row
    FROM cells, LATERAL (SELECT unnest(range(0, cols - 1)) AS col) c, LATERAL (SELECT unnest(range(0, rows)) AS row) r
    """,
    "cells",
)
ORACLE["placements"] = _sql("SELECT grid_id, col, row FROM spots", "spots")
ORACLE["placed_labels"] = _sql(
    """
    SELECT grid_id, col, row, CAST(printf('%.6f', (x + col * cw + 2 + (2 * cw - 4) / 2) / 1920) AS DOUBLE) AS cx,
           CAST(printf('%.6f', (y + row * ch + 2 + (ch - 4) / 2) / 1080) AS DOUBLE) AS cy,
           CAST(printf('%.6f', (2 * cw - 4) / 1920) AS DOUBLE) AS w, CAST(printf('%.6f', (ch - 4) / 1080) AS DOUBLE) AS h
    FROM spots
    """,
    "spots",
)
ORACLE["correction_samples"] = _sql(
    """
    SELECT f.ts, f.session_id AS session,
           'crops/' || f.session_id || '_' || f.icon_id || '_'
             || (row_number() OVER (PARTITION BY f.session_id, f.icon_id ORDER BY det_idx) - 1) || '.png' AS crop,
           concat_ws(',', x0, y0, x1, y1) AS box, f.icon_id, f.item_id, coalesce(n.name, '') AS item_name
    FROM (SELECT CAST(ok AS VARCHAR) AS session_id, CAST(pk AS VARCHAR) AS icon_id, CAST(max(day) AS VARCHAR) AS ts,
                 CAST(min(sk) AS VARCHAR) AS item_id FROM li WHERE rf = 'R' GROUP BY ok, pk) f
    JOIN detections d ON d.session_id = f.session_id AND d.icon_id = f.icon_id
    LEFT JOIN names n ON n.item_id = f.item_id
    """,
    "detections",
    "names",
)
_fragment(
    "drawn",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderstatus AS ts,
           CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS item_id,
           CAST(round_even(least(x0, x1), 0) AS INTEGER) AS bx0, CAST(round_even(least(y0, y1), 0) AS INTEGER) AS by0,
           CAST(round_even(greatest(x0, x1), 0) AS INTEGER) AS bx1, CAST(round_even(greatest(y0, y1), 0) AS INTEGER) AS by1
    FROM (SELECT *, x0 + CAST(o_orderkey % 41 - 20 AS DOUBLE) / 2 AS x1, y0 + CAST(cents % 53 AS DOUBLE) / 4 AS y1
          FROM (SELECT *, CAST(cents % 19000 AS DOUBLE) / 10 AS x0, CAST(cents % 10007 AS DOUBLE) / 10 AS y0
                FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)))
    """,
)
ORACLE["missed_samples"] = _sql(
    """
    SELECT ts, session_id AS session, 'missed/' || concat_ws('_', session_id, bx0, by0, bx1, by1) || '.png' AS crop,
           concat_ws(',', bx0, by0, bx1, by1) AS box, d.item_id, coalesce(n.name, '') AS item_name
    FROM drawn d LEFT JOIN names n ON n.item_id = d.item_id
    WHERE bx1 - bx0 >= 4 AND by1 - by0 >= 4
    """,
    "drawn",
    "names",
)
ORACLE["gallery_merge"] = _sql(
    """
    SELECT class_idx, 'generated' AS origin, 3 AS n FROM (SELECT row_number() OVER (ORDER BY icon_id) - 1 AS class_idx FROM icons)
    UNION ALL
    SELECT class_idx, 'gallery', count(*) FROM li
    JOIN (SELECT icon_id, row_number() OVER (ORDER BY icon_id) - 1 AS class_idx FROM icons) c ON c.icon_id = li.pk GROUP BY class_idx
    """,
    "icons",
    "li",
)
ORACLE["parsed_boxes"] = """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS INTEGER) END AS b0,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS INTEGER) END AS b1,
           CASE WHEN o_orderstatus <> 'P' THEN 12 END AS b2, CASE WHEN o_orderstatus <> 'P' THEN 9 END AS b3
    FROM orders
"""

# --- geometry ----------------------------------------------------------------------------

ORACLE["word_to_box"] = _sql(
    """
    SELECT w.session_id, w.det_idx AS word_id, max(b.det_idx) AS box_id
    FROM detections w JOIN detections b ON w.session_id = b.session_id
     AND w.x0 + w.quantity * 3 BETWEEN b.x0 AND b.x1 AND w.y0 + w.quantity * 2 BETWEEN b.y0 AND b.y1
    GROUP BY w.session_id, w.det_idx
    """,
    "detections",
)
ORACLE["point_in_container"] = _sql(
    """
    SELECT c_nationkey AS scope, c_custkey AS click, max(grid_id) AS grid_id
    FROM customer JOIN grids ON scope = c_nationkey AND c_custkey * 37 % 1920 BETWEEN x AND x + w
     AND c_custkey * 91 % 1080 BETWEEN y AND y + h
    GROUP BY c_nationkey, c_custkey
    """,
    "grids",
)

# --- manifests ---------------------------------------------------------------------------

_fragment("assets", "SELECT doc_id AS icon_id, sha256(text) AS sha256 FROM documents")
ORACLE["asset_digests"] = _sql("SELECT * FROM assets", "assets")


def _tree(assets: str, key: str = "0 AS key") -> str:
    """Hash tree over ``icon_id, sha256`` of each key: one row per key with ``line`` as its root hash."""
    tree = f"SELECT {key}, md5(CAST(icon_id AS VARCHAR)) AS node, icon_id || ':' || sha256 AS line, 1 AS icons FROM {assets}"
    for depth in (4, 3, 2, 1, 0):
        tree = f"""
        SELECT key, node, CASE WHEN node <> '' THEN node[{depth}] || ':' ELSE '' END || sha256(string_agg(line, chr(10) ORDER BY line)) AS line,
               sum(icons) AS icons
        FROM (SELECT key, substr(node, 1, {depth}) AS node, line, icons FROM ({tree})) GROUP BY key, node
        """
    return tree


def _deep_tree(assets: str, leaf: int = 256, most: int = 5) -> str:
    """CTEs of a hash tree whose depth follows from the number of lines, up to a root ``t0``; levels that it lacks pass through."""
    out = f"""
    depth AS (SELECT greatest(0, CAST(ceil(ln(greatest(count(*), 1) / {leaf}.0::DOUBLE) / ln(16.0::DOUBLE) - 1e-12) AS BIGINT)) AS d FROM {assets}),
    t{most + 1} AS (SELECT md5(CAST(icon_id AS VARCHAR)) AS node, icon_id || ':' || sha256 AS line, CAST(1 AS BIGINT) AS icons FROM {assets})"""
    for k in range(most, -1, -1):
        out += f""",
    t{k} AS (
      SELECT substr(node, 1, {k}) AS node, substr(node, {k}, 1) || CASE WHEN {k} > 0 THEN ':' ELSE '' END || sha256(string_agg(line, chr(10) ORDER BY line)) AS line,
             CAST(sum(icons) AS BIGINT) AS icons
      FROM t{k + 1}, depth WHERE {k} <= d GROUP BY substr(node, 1, {k}), substr(node, {k}, 1)
      UNION ALL SELECT node, line, icons FROM t{k + 1}, depth WHERE {k} > d)"""
    return out


ORACLE["set_fingerprint"] = (
    _sql("", "assets").rstrip() + "," + _deep_tree("assets") + " SELECT line AS fingerprint, icons FROM t0"
)
_fragment(
    "trained",
    """
    SELECT lower(c_mktsegment) || '-v' || c_nationkey AS model, CAST(c_custkey * 3 AS VARCHAR) AS icon_id, c_custkey AS class_idx FROM customer
    """,
)
_fragment("cached", "SELECT CAST(p_partkey AS VARCHAR) AS icon_id FROM part")
ORACLE["missing_assets"] = _sql(
    "SELECT model, icon_id FROM trained WHERE icon_id NOT IN (SELECT icon_id FROM cached)", "trained", "cached"
)
ORACLE["release_summary"] = _sql(
    """
    SELECT model, count(*) AS classes, count(DISTINCT t.icon_id) AS unique_icons,
           count(DISTINCT c.icon_id) AS icon_count, count(DISTINCT t.icon_id) - count(DISTINCT c.icon_id) AS icons_missing
    FROM trained t LEFT JOIN cached c ON t.icon_id = c.icon_id GROUP BY model
    """,
    "trained",
    "cached",
)
_fragment("hashed", "SELECT CAST(p_partkey AS VARCHAR) AS icon_id, sha256(p_name) AS sha256 FROM part")
_fragment("bound", "SELECT DISTINCT model, icon_id, sha256 FROM trained JOIN hashed USING (icon_id)", "trained", "hashed")
_fragment(
    "release_texts",
    """
    SELECT model, file, string_agg(line, '' ORDER BY class_idx) AS text FROM (
      SELECT model, class_idx, icon_id || ':' || sha256(CAST(class_idx AS VARCHAR)) || chr(10) AS line,
             unnest(['links/links.txt', 'icons/part-' || class_idx // 1000 || '.txt']) AS file
      FROM trained) GROUP BY model, file
    """,
    "trained",
)
_fragment(
    "released",
    """
    SELECT model, file, any_value(length(text)) AS length,
           CASE WHEN any_value(length(text)) <= 512 THEN sha256(any_value(text)) ELSE sha256(string_agg(sha256(substr(text, 512 * i + 1, 512)), chr(10) ORDER BY i)) END AS sha256
    FROM (SELECT *, unnest(range((greatest(length(text), 1) + 511) // 512)) AS i FROM release_texts) GROUP BY model, file
    """,
    "release_texts",
)
ORACLE["release_files"] = _sql("SELECT model || '/' || file AS name, length, sha256 FROM released", "released")
ORACLE["release_manifest"] = _sql(
    f"""
    SELECT t.model AS name, regexp_extract(t.model, '^(.*)-', 1) AS model, regexp_extract(t.model, '-([^-]*)$', 1) AS version,
           count(*) AS classes, count(DISTINCT h.icon_id) AS icon_count,
           count(DISTINCT t.icon_id) - count(DISTINCT h.icon_id) AS icons_missing, any_value(f.line) AS icons_fingerprint,
           '2024-01-01T00:00:00' AS built_at, '0.1.0' AS min_app_version, any_value(l.files) AS files
    FROM trained t LEFT JOIN (SELECT model, string_agg(file || ':' || sha256, ' ' ORDER BY file) AS files FROM released GROUP BY model) l ON l.model = t.model
    LEFT JOIN hashed h ON t.icon_id = h.icon_id LEFT JOIN ({_tree("bound", "model AS key")}) f ON f.key = t.model
    GROUP BY t.model
    """,
    "bound",
    "released",
)
ORACLE["model_fingerprint"] = _sql(
    "SELECT model, sha256(string_agg(icon_id || ':' || sha256, chr(10) ORDER BY icon_id || ':' || sha256)) AS fingerprint, count(*) AS icons FROM bound GROUP BY model",
    "bound",
)
ORACLE["model_names"] = """
    SELECT DISTINCT CASE c_nationkey WHEN 0 THEN segment WHEN 1 THEN '-' || segment ELSE segment || '-x-' || c_nationkey END AS name,
           CASE c_nationkey WHEN 0 THEN segment WHEN 1 THEN '-' || segment ELSE segment || '-x' END AS model,
           CASE WHEN c_nationkey > 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS version
    FROM (SELECT c_nationkey, lower(c_mktsegment) AS segment FROM customer)
"""
ORACLE["ordered_icons"] = "SELECT l_partkey AS icon, min(l_orderkey) AS first_pos FROM lineitem GROUP BY l_partkey"


def _pictures(key: str, vec: str) -> str:
    return f"""
    SELECT {key} AS icon_id,
           sha256(array_to_string(list_transform({vec}, lambda v: CAST(CAST(round(v) AS INTEGER) AS VARCHAR)), ',')) AS sha256,
           list_transform(range(1, 64), lambda i: ({vec})[i + 1] > ({vec})[i]) AS bits
    FROM vectors
    """


_fragment("before", _pictures("icon_id", "vec"), "vectors")
_fragment(
    "live_vectors",
    """
    SELECT CASE WHEN icon_id % 13 = 0 THEN icon_id + 1000000 WHEN icon_id % 17 = 0 THEN icon_id + 2000000 ELSE icon_id END AS icon_id,
           CASE WHEN icon_id % 17 = 0 THEN list_transform(vec, lambda v: -v)
                WHEN icon_id % 7 = 0 THEN list_reverse(vec)
                WHEN icon_id % 11 = 0 THEN list_transform(vec, lambda v: v + 3) ELSE vec END AS vec
    FROM vectors
    """,
    "vectors",
)
_fragment("after", _pictures("icon_id", "vec").replace("FROM vectors", "FROM live_vectors"), "live_vectors")
ORACLE["manifest_drift"] = _sql(
    """
    SELECT coalesce(b.icon_id, a.icon_id) AS icon_id,
           CASE WHEN b.icon_id IS NULL THEN 'new'
                WHEN a.icon_id IS NULL THEN CASE WHEN h.new_id IS NULL THEN 'removed' ELSE 'rekeyed' END
                WHEN a.sha256 = b.sha256 THEN 'unchanged'
                WHEN len(list_filter(range(1, 64), lambda i: a.bits[i] <> b.bits[i])) <= 4 THEN 'cosmetic'
                ELSE 'changed' END AS status,
           CASE WHEN a.icon_id IS NULL THEN h.new_id END AS new_id
    FROM before b FULL JOIN after a ON a.icon_id = b.icon_id
    LEFT JOIN (SELECT sha256, min(icon_id) AS new_id FROM after GROUP BY sha256) h ON h.sha256 = b.sha256
    """,
    "before",
    "after",
)
ORACLE["fetch_worklist"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'https://icons.example/' || p_partkey AS link
    FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 9 <> 0
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = p_partkey AND o_orderstatus = 'F')
"""
ORACLE["freshness"] = """
    SELECT event_type, user_id, round_even(seconds / 3600.0::DOUBLE, 1) AS age_h, seconds >= 86400 AS stale
    FROM (SELECT event_type, user_id, date_sub('second', max(ts), TIMESTAMP '2024-01-15 00:00:00') AS seconds
          FROM events GROUP BY event_type, user_id)
"""
ORACLE["image_listing"] = """
    SELECT 'tpl:' || n_name AS id, false AS reviewed FROM nation
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), o_orderkey IN (SELECT l_orderkey FROM lineitem) FROM orders
"""

# --- reports -----------------------------------------------------------------------------

ORACLE["confidence_report"] = _sql(
    """
    SELECT quantity % 2 = 0 AS turned, count(*) AS detections,
           round_even(CAST(sum(CAST(round(det_conf * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000, 6) AS mean_conf,
           round_even(quantile_cont(round(det_conf * 1000), 0.5) / 1000, 6) AS median_conf,
           CAST(min(CAST(round(det_conf * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS min_conf
    FROM detections GROUP BY 1
    """,
    "detections",
)
ORACLE["recall_report"] = _sql(
    """
    SELECT quantity % 2 = 0 AS turned, count(*) AS items, count(source) AS hits,
           round_even(CAST(count(source) AS DOUBLE) / count(*), 4) AS recall
    FROM records GROUP BY 1
    """,
    "records",
)
ORACLE["version_delta"] = _sql(
    """
    SELECT session_id, count(*) FILTER (WHERE det_conf >= 0.4::DOUBLE) AS before, count(*) AS after,
           count(*) - count(*) FILTER (WHERE det_conf >= 0.4::DOUBLE) AS gain
    FROM detections WHERE det_conf >= 0.25::DOUBLE GROUP BY session_id
    """,
    "detections",
)
ORACLE["training_summary"] = """
    SELECT l.event_type AS model, b.event_id AS best_epoch, b.value AS best_quality,
           l.event_id AS last_epoch, l.value AS last_quality, l.event_id * 2 AS seconds
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) l
    JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) b
      ON b.event_type = l.event_type AND b.rn = 1
    WHERE l.rn = 1
"""

# --- files and streams -------------------------------------------------------------------

ORACLE["catalog_last_wins"] = _sql(
    f"""
    SELECT id, "basePrice", file, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY file DESC, pos DESC) AS rn
      FROM (SELECT CAST(pk AS VARCHAR) AS id, unit AS "basePrice", ok AS file, {INDEX} AS pos FROM li)) WHERE rn = 1
    """,
    "li",
)
ORACLE["event_log_scan"] = """
    SELECT CASE WHEN event_type = 'purchase' THEN 'manual' ELSE 'visual' END AS source, count(*) AS lines, max(event_id) AS last_seq
    FROM events GROUP BY 1
    UNION ALL SELECT 'rejected', count(*), NULL FROM supplier
"""
ORACLE["label_files"] = _sql(
    f"""
    SELECT scope AS scene, CASE WHEN {digest("'7'", "'split'", "scope")} < CAST(floor(0.1 * 4294967296) AS BIGINT) THEN 'val' ELSE 'train' END AS split,
           printf('%d %.6f %.6f %.6f %.6f', grid_id, (x + col * cw + 2 + (cw - 4) / 2) / 1920, (y + row * ch + 2 + (ch - 4) / 2) / 1080,
                  (cw - 4) / 1920, (ch - 4) / 1080) AS value
    FROM cells, LATERAL (SELECT unnest(range(0, cols)) AS col) c, LATERAL (SELECT unnest(range(0, rows)) AS row) r
    """,
    "cells",
)
ORACLE["stream_current_links"] = ORACLE["stream_compacted_links"] = ORACLE["link_latest_event"]
ORACLE["link_changes"] = _sql(
    """
    SELECT icon_id, arg_max(item_id, seq) AS item_id, max(seq) AS seq, v AS version
    FROM (SELECT *, CAST(seq % 3 AS INTEGER) AS arrived FROM link_events WHERE source = 'manual' AND item_id <> '') e, range(1, 3) r(v)
    WHERE arrived <= v GROUP BY icon_id, v HAVING max(arrived) FILTER (WHERE arrived = v) IS NOT NULL
    """,
    "link_events",
)
ORACLE["stream_valued_records"] = ORACLE["session_summary"]
for _name in ("stream_reprojection", "stream_split_sessions", "stream_scan_and_correct", "stream_price_refresh"):
    ORACLE[_name] = ORACLE["session_summary"]
ORACLE["stored_session"] = (
    "SELECT * FROM (" + ORACLE["resolve_identity"] + ") WHERE session_id = (SELECT CAST(max(CAST(l_orderkey AS VARCHAR)) AS VARCHAR) FROM lineitem)"
)
_CATALOG = "item_id, name, short, width, height, avg24h, low, base"
ORACLE["catalog_json_scan"] = _sql(f"SELECT {_CATALOG} FROM catalog", "catalog")
ORACLE["snapshot_scan"] = ORACLE["catalog_json_scan"]
ORACLE["link_map_scan"] = _sql("SELECT icon_id, item_id, name, short, score, margin, false AS pinned FROM auto", "auto")
ORACLE["metrics_csv"] = "SELECT * REPLACE (CAST(seconds AS DOUBLE) AS seconds) FROM (" + ORACLE["training_summary"] + ")"
_fragment(
    "pngs",
    """
    SELECT icon_id, px_w, 64 // px_w AS px_h, vec FROM (
      SELECT *, CASE icon_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 4 ELSE 64 END AS px_w FROM vectors)
    """,
    "vectors",
)
# Signature, three chunks with 12 bytes around each, 13 bytes of header, and the rows stored in one block of 11 bytes.
ORACLE["image_files"] = _sql(
    """
    SELECT icon_id, px_w, px_h, CAST(px_h * (px_w + 1) + 68 AS BIGINT) AS length,
           greatest(1, CAST(round_even((px_w - 1) / 63.0::DOUBLE, 0) AS INTEGER)) AS cells_w,
           greatest(1, CAST(round_even((px_h - 1) / 63.0::DOUBLE, 0) AS INTEGER)) AS cells_h
    FROM pngs
    """,
    "pngs",
)
ORACLE["image_contents"] = _sql(
    "SELECT icon_id, md5(array_to_string(list_transform(vec, lambda v: CAST(floor(abs(v)) AS INTEGER) % 256), ',')) AS grey_md5 FROM pngs", "pngs"
)
ORACLE["plain_log_scan"] = _sql(
    """
    SELECT row_number() OVER (ORDER BY seq) - 1 + 2 * coalesce(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END)
             OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq, icon_id, item_id, source
    FROM link_events
    """,
    "link_events",
)
ORACLE["name_match_levenshtein"] = _sql(
    """
    SELECT text, key, item_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, key DESC) AS rn FROM (
        SELECT text, key, item_id, 1 - levenshtein(text, key) / greatest(length(text), length(key))::DOUBLE AS score
        FROM (SELECT DISTINCT text FROM texts WHERE text <> '')
        JOIN full_index ON least(length(text), length(key)) >= 0.6 * greatest(length(text), length(key)) - 1e-9
      ) WHERE score >= 0.6)
    WHERE rn = 1
    """,
    "texts",
    "full_index",
)
