"""SQL of the queries that SQL can state; the others are tested against brute force in tests/llm."""

from __future__ import annotations

# Fixed values, kept apart from the operator's own table: letters beside the Latin letters that they can't be told from.
_CYRILLIC = "АВЕКМНОРСТХЅІЈаеорсухѕіјһԁ", "ABEKMHOPCTXSIJaeopcyxsijhd"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"


def _look(column: str) -> str:
    """The look of a text: letters of the same shape as one, marks composed, what doesn't show removed, single blanks."""
    shapes = _CYRILLIC[0] + _GREEK[0] + "ÐƉ", _CYRILLIC[1] + _GREEK[1] + "ĐĐ"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    kana = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
    a, b = (x + y + z for x, y, z in zip(shapes, wide, kana))
    a, b = a.replace("'", "''"), b.replace("'", "''")
    return f"trim(regexp_replace(nfc_normalize(regexp_replace(translate({column}, '{a}', '{b}'), '\\p{{Cf}}', '', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    number = "regexp_extract(group_id, '^\\s*\\p{L}*\\s*0*([0-9]+)\\s*$', 1)"
    group = f"CASE WHEN {number} <> '' THEN 'g' || lpad({number}, cast(greatest(7, length({number})) AS INT), '0') ELSE nullif(lower(trim(group_id)), '') END"
    return {
        "p2_found": f"""
            WITH looks AS (SELECT line_id, text, {_look('text')} AS look FROM ocr_lines WHERE text IS NOT NULL),
            phrases AS (SELECT phrase, {_look('phrase')} AS look FROM print_phrases)
            SELECT DISTINCT 'ocr_lines' AS src, line_id AS row_key FROM looks JOIN phrases USING (look) WHERE text <> phrase
            UNION ALL
            SELECT DISTINCT 'label_corrections', correction_id FROM label_corrections
            WHERE old_text <> new_text AND {_look('old_text')} = {_look('new_text')}""",
        "p2_canonical": f"""
            WITH l AS (SELECT line_id, any_value(text) AS text FROM ocr_lines GROUP BY line_id),
            c AS (SELECT correction_id, any_value(old_text) AS a, any_value(new_text) AS b FROM label_corrections GROUP BY correction_id),
            t AS (SELECT text FROM l UNION ALL SELECT a FROM c UNION ALL SELECT b FROM c)
            SELECT {_look('text')} AS form, count(DISTINCT text) AS writings, count(*) AS texts FROM t WHERE text IS NOT NULL GROUP BY 1""",
        "p3_found": """
            WITH RECURSIVE links AS (
                SELECT image_a AS u, image_b AS v FROM match_pairs WHERE matched AND image_a <> image_b
                UNION SELECT image_b, image_a FROM match_pairs WHERE matched AND image_a <> image_b),
            reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
            here AS (SELECT DISTINCT image_id FROM ocr_manifest)
            SELECT u AS image_id, least(u, min(v)) AS root_id FROM reach JOIN here a ON u = a.image_id JOIN here b ON v = b.image_id
            WHERE u <> v GROUP BY u""",
        "p3_groups": """
            WITH RECURSIVE links AS (
                SELECT image_a AS u, image_b AS v FROM match_pairs WHERE matched AND image_a <> image_b
                UNION SELECT image_b, image_a FROM match_pairs WHERE matched AND image_a <> image_b),
            reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
            here AS (SELECT DISTINCT image_id FROM ocr_manifest)
            SELECT a.image_id, least(a.image_id, min(b.image_id)) AS root_id
            FROM here a LEFT JOIN reach ON u = a.image_id LEFT JOIN here b ON v = b.image_id GROUP BY a.image_id""",
        "p4_found": f"""
            SELECT {group} AS group_id FROM ocr_manifest WHERE lower(trim(split)) IN ('train', 'val', 'test') AND {group} IS NOT NULL
            GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1""",
        "p4_invariants": f"""
            SELECT count(DISTINCT image_id) AS photographs, count(DISTINCT image_id) AS distinct_ids, true AS near_shares,
            count(DISTINCT {group}) AS groups, 0::BIGINT AS torn FROM ocr_manifest WHERE image_id IS NOT NULL""",
        "p9_invariants": """
            SELECT limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS divided_short, 0::BIGINT AS over_tokens, 0::BIGINT AS over_segments, 0::BIGINT AS over_loss
            FROM pack_limits WHERE capacity_tokens > 0""",
    }
