"""Expected values in DuckDB SQL, computed from the base tables without parsing any text.

`people` holds what each written document must yield when it is read back; the oracle of a query is a select
over it.
"""

from __future__ import annotations

from prosopon.functions.roles import ORDINALS
from prosopon.plans import synth


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STATUS_FACTS = ", ".join(
    f"min(year(o_orderdate)) FILTER (WHERE o_orderstatus = '{s}') AS {s}_from, "
    f"max(year(o_orderdate)) FILTER (WHERE o_orderstatus = '{s}') AS {s}_to, "
    f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}_n"
    for s in "FOP"
)
PRIORITY_FACTS = ", ".join(f"count(*) FILTER (WHERE o_orderpriority LIKE '{p}%') AS p{p}" for p in range(1, 6))

BASE = f"""
facts AS (
  SELECT o_custkey, max(o_orderdate) AS last_order, {STATUS_FACTS}, {PRIORITY_FACTS} FROM orders GROUP BY o_custkey),
base AS (
  SELECT 'entry-' || c_custkey AS doc_id, c_custkey::VARCHAR AS k, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS nk,
    r_name AS region, facts.*,
    'ka' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS stem
  FROM customer LEFT JOIN facts ON c_custkey = o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
worded AS (
  SELECT *, upper(stem) AS up, 'K' || substr(stem, 2) AS cap, bal >= -600 AS named, bal >= -200 AS has_roles,
    CASE WHEN bal < 3000 THEN 'Ana Lúcia' ELSE 'Jan' END AS given,
    ({_list([r[3] for r in synth.NATIONS])})[nk + 1] AS spelling,
    ({_list([r[0] for r in synth.NATIONS])})[nk + 1] AS state_name,
    ({_list(ORDINALS)})[least(F_n, 16)] AS f_ord, ({_list(ORDINALS)})[least(P_n, 16)] AS p_ord
  FROM base),
clauses AS (
  SELECT *,
    CASE seg WHEN 'BUILDING' THEN up || '-LEE' WHEN 'FURNITURE' THEN 'VAN ' || up WHEN 'HOUSEHOLD' THEN 'O’' || up
      WHEN 'MACHINERY' THEN '[VAN DER] É' || up ELSE up END AS written,
    CASE seg WHEN 'BUILDING' THEN cap || '-Lee' WHEN 'FURNITURE' THEN 'van ' || cap WHEN 'HOUSEHOLD' THEN 'O’' || cap
      WHEN 'MACHINERY' THEN 'van der É' || stem ELSE cap END AS surname,
    CASE seg WHEN 'BUILDING' THEN ' (née Harlem)' WHEN 'FURNITURE' THEN ' (known as Van ' || cap || ')'
      WHEN 'HOUSEHOLD' THEN ' (Bob)' WHEN 'MACHINERY' THEN ' (called Ted)' ELSE '' END AS paren,
    list_filter([
      CASE WHEN F_n > 0 THEN f_ord || ' Secretary-General of the Organisation of ' || region || ' States (OAS), '
        || CASE WHEN F_from = F_to THEN F_from::VARCHAR ELSE F_from || '–' || F_to END END,
      CASE WHEN O_n > 0 THEN 'Director to the ' || region || ' Commission (UN EC) Secretariat '
        || CASE WHEN O_from = O_to THEN 'in ' || O_from ELSE O_from || '-' || O_to END END,
      CASE WHEN P_n > 0 THEN p_ord || ' United Nations High Commissioner for Refugees '
        || CASE WHEN P_from = P_to THEN 'March-May ' || P_from ELSE P_from || ' - ' || P_to END END
    ], lambda x: x IS NOT NULL) AS cl,
    list_filter([{', '.join(f"CASE WHEN p{p} > 0 THEN 'Priority {p} papers, http://arch.example/;box=' || p{p} END" for p in range(1, 6))}],
      lambda x: x IS NOT NULL) AS arch,
    'Ada N' || nk || CASE seg WHEN 'BUILDING' THEN ', Jr. and Bo Ray' WHEN 'FURNITURE' THEN ' & Cy Orr and Bo Ray' ELSE '' END AS writer,
    CASE seg WHEN 'MACHINERY' THEN 'Version ' || year(last_order) WHEN 'HOUSEHOLD' THEN 'Version 31 February 2019'
      ELSE 'Version ' || day(last_order) || ' ' || strftime(last_order, '%B') || ' ' || year(last_order) END AS ver
  FROM worded),
people AS (
  SELECT *,
    CASE WHEN named THEN surname END AS last_name, CASE WHEN named THEN given END AS first_name,
    CASE WHEN named THEN CASE seg WHEN 'FURNITURE' THEN 'Van ' || cap WHEN 'HOUSEHOLD' THEN 'Bob' WHEN 'MACHINERY' THEN 'Ted' END END AS known_as,
    CASE WHEN named AND seg = 'BUILDING' THEN 'Harlem' END AS nee,
    CASE WHEN bal < -600 THEN NULL WHEN bal < -400 THEN 'Martian economist and former diplomat' WHEN bal < -200 THEN '1995-1999'
      ELSE spelling || ' lawyer and ' || coalesce(cl[1], '')
        || CASE WHEN len(cl) > 1 THEN ' and ' || array_to_string(cl[2:], ', ') ELSE '' END END AS summary,
    CASE WHEN named THEN 'Was born 1 January 1950 in ' || region || ' and died in Rome' END AS life,
    CASE WHEN has_roles THEN spelling END AS nationality, CASE WHEN has_roles THEN state_name END AS country,
    coalesce(F_n > 2, false) AS has_source, coalesce(p1 > 0, false) AS has_archives, coalesce(O_n > 2, false) AS has_publications,
    coalesce(P_n > 1, false) AS has_literature, coalesce(P_n > 0, false) AS has_citation,
    last_order IS NOT NULL AND seg <> 'AUTOMOBILE' AS has_version, coalesce(F_n > 1, false) AS has_photo
  FROM clauses),
fields AS (
  SELECT *,
    CASE WHEN has_source THEN 'Photograph by K. Stone – https://www.pics' || nk || '.example/p/' || k || '?a=1&b=2).' END AS image_source,
    CASE WHEN has_citation THEN writer END AS authors, CASE WHEN has_version THEN ver END AS version,
    list_filter([CASE WHEN seg = 'BUILDING' THEN 'Name changed in ' || region || '.' END,
      CASE WHEN has_source AND seg = 'FURNITURE' THEN 'On film: see the newsreel' END], lambda x: x IS NOT NULL) AS notes,
    CASE WHEN has_archives THEN arch ELSE [] END AS archive_items,
    CASE WHEN has_publications THEN ['On ' || region || ', 1999', 'Memoirs'] ELSE [] END AS publication_items,
    CASE WHEN has_literature THEN ['Life of ' || up] ELSE [] END AS literature_items,
    CASE WHEN bal < -800 THEN '' WHEN bal < -600 THEN written || ' has no readable vitals'
      ELSE written || ', ' || given || paren || ', ' || summary || ', was born 1 January 1950 in ' || region || ' and died in Rome' END AS intro
  FROM people),
held AS (
  SELECT doc_id, ord, title, org, abbr, y1, y2, row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS role_index FROM (
    SELECT doc_id, 1 AS slot, f_ord AS ord, 'Secretary-General' AS title, 'Organisation of ' || region || ' States' AS org, 'OAS' AS abbr, F_from AS y1, F_to AS y2
      FROM people WHERE has_roles AND F_n > 0
    UNION ALL SELECT doc_id, 2, NULL, 'Director', region || ' Commission Secretariat', 'UN EC', O_from, O_to FROM people WHERE has_roles AND O_n > 0
    UNION ALL SELECT doc_id, 3, p_ord, 'United Nations High Commissioner for Refugees',
      'Office of the United Nations High Commissioner for Refugees', 'UNHCR', P_from, P_to FROM people WHERE has_roles AND P_n > 0)),
listing AS (
  SELECT f.doc_id AS slug, coalesce(role_index, -1) AS role_index, upper(coalesce(last_name, '')) || ' ' || coalesce(first_name, '')
      || CASE seg WHEN 'BUILDING' THEN CASE WHEN named THEN ' (née Harlem)' ELSE '' END WHEN 'HOUSEHOLD' THEN CASE WHEN named THEN ' (Bob)' ELSE '' END
        WHEN 'MACHINERY' THEN CASE WHEN named THEN ' (Ted)' ELSE '' END ELSE '' END AS name,
    coalesce(title, '') AS role, coalesce(org || ' (' || abbr || ')', '') AS organisation,
    CASE WHEN y1 IS NULL THEN '' ELSE y1 || '–' || y2 END AS years, coalesce(nationality, 'Unspecified') AS nationality
  FROM fields f LEFT JOIN held h ON f.doc_id = h.doc_id),
shown AS (
  SELECT *, '<p>' || intro || '</p>' AS h_intro,
    CASE WHEN seg = 'BUILDING' THEN '<p><em> Name changed in ' || region || '. </em></p>' ELSE '' END AS h_note,
    CASE WHEN has_source THEN '<p>Source: Photograph by K. Stone – https://www.pics' || nk || '.example/p/' || k || '?a=1&#x26;b=2).</p>' ELSE '' END AS h_source,
    CASE WHEN seg = 'FURNITURE' THEN '<p>On film: see the newsreel</p>' ELSE '' END AS h_media,
    '<h2>Biography</h2><p>Life &#x26; work in ' || region || ' &#x3C;<em><strong>' || k || '</strong></em><u>> </u></p>'
      || CASE WHEN seg = 'MACHINERY' THEN '<p>' || repeat('{synth.LONG_TEXT}', 15) || '</p>' ELSE '' END || '<li>Post ' || k || '</li>' AS h_life,
    CASE WHEN has_literature THEN '<p>By ' || replace(upper(writer), '&', '&#x26;') || '</p>' ELSE '' END AS h_by,
    CASE WHEN has_archives THEN '<p> ' || array_to_string(list_transform(arch[1:2], lambda x: x || ';'), ' ') || '</p><p> '
      || array_to_string(arch[3:], ';  ') || '. (all websites accessed 1 May 2020).</p>' ELSE '' END AS h_archives,
    CASE WHEN has_publications THEN '<p> On ' || region || ', 1999;; ; Memoirs,; </p>' ELSE '' END AS h_publications,
    CASE WHEN has_literature THEN '<p>Life of ' || up || '.</p>' ELSE '' END AS h_literature,
    CASE WHEN has_version THEN '<p><strong>' || ver || '</strong></p>' ELSE '' END AS h_version,
    CASE WHEN has_citation THEN '<p><strong>How to cite this Lives Register entry?</strong></p><p>' || replace(writer, '&', '&#x26;')
      || ', ‘' || written || ', ' || given || '’ {synth.PROFILE.citation_marker}, version 1</p>' ELSE '' END AS h_cite
  FROM fields),
pages_of AS (
  SELECT *, CASE WHEN has_source THEN '' ELSE h_media END || h_life AS body,
    h_intro || h_note || '<p></p>' || h_source || h_media || '<p></p>' || h_life || h_by || h_archives || h_publications || h_literature || h_version || h_cite AS html
  FROM shown),
flags AS (
  SELECT doc_id, unnest(list_filter([
    CASE WHEN NOT has_source THEN 'image_source_missing' END, CASE WHEN NOT has_photo THEN 'image_attachment_missing' END,
    CASE WHEN bal < -800 THEN 'intro_missing' END,
    CASE WHEN bal >= -800 AND bal < -600 THEN 'name_unparsed' END, CASE WHEN bal >= -800 AND bal < -600 THEN 'summary_unparsed' END,
    CASE WHEN bal >= -800 AND bal < -600 THEN 'life_unparsed' END,
    CASE WHEN bal < -600 THEN 'roles_missing_input' END, CASE WHEN bal >= -600 AND bal < -400 THEN 'roles_no_year_span' END,
    CASE WHEN bal >= -400 AND bal < -200 THEN 'role_unparsed' END,
    CASE WHEN bal < -600 THEN 'nationality_missing_input' END, CASE WHEN bal >= -600 AND bal < -200 THEN 'nationality_unknown' END,
    CASE WHEN NOT has_version THEN 'version_missing' END, CASE WHEN NOT has_citation THEN 'citation_missing' END,
    CASE WHEN NOT has_archives THEN 'apl_archives_missing' END, CASE WHEN NOT has_publications THEN 'apl_publications_missing' END,
    CASE WHEN NOT has_literature THEN 'apl_literature_missing' END], lambda x: x IS NOT NULL)) AS code
  FROM fields)
"""

SEVERITY = (
    "CASE WHEN code IN ('intro_missing', 'name_unparsed', 'summary_unparsed') THEN 'error' "
    "WHEN code IN ('apl_archives_missing', 'apl_publications_missing') THEN 'info' ELSE 'warn' END"
)


def people(select: str, *ctes: str) -> str:
    """A select over the expected tables: people, fields, held, listing, pages_of, flags."""
    return "WITH " + ", ".join([BASE, *ctes]) + " " + select


def roles_json(alias: str = "roles") -> str:
    """Canonical JSON of a person's roles, correlated on doc_id, built in `rj`."""
    return (
        "rj AS (SELECT doc_id, '[' || string_agg('{\"title\":\"' || title || '\",\"abbreviation\":\"' || abbr || '\",\"organisation\":\"' "
        f"|| org || '\"}}', ',' ORDER BY role_index) || ']' AS {alias} FROM held GROUP BY doc_id)"
    )


def content_hash_cte() -> str:
    """`hashed`: doc_id and content hash, needs `rj`."""
    pairs = " || ',' || ".join(
        f"'\"{key}\":\"' || replace(coalesce({col}, ''), '\"', '\\\"') || '\"'"
        for key, col in (
            ("html", "html"), ("summary", "summary"), ("life", "life"), ("version", "version"),
            ("authors", "authors"), ("nationality", "nationality"),
        )
    )
    return (
        f"hashed AS (SELECT p.*, rj.roles AS roles_text, 'sha256:' || sha256('{{' || {pairs} || ',\"roles\":' || coalesce(rj.roles, '[]') || '}}') "
        "AS content_hash FROM pages_of p LEFT JOIN rj ON p.doc_id = rj.doc_id)"
    )
