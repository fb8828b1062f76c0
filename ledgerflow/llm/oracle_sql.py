r"""DuckDB SQL for the operators that SQL can express, written from their rules.

No SQL: classifier (1), SimHash (3; XXH64 and bit counts over shingles), packing (6), token records (7), token
counts (8), disclosing terms (10), runs (11), shards (13; CRC-32). Their tests hold them against brute force or a round trip.
"""

from __future__ import annotations


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


# Fixed values of the quality rules, written out here: the SQL takes nothing from the operator.
_MENU = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top", "contact",
         "about", "sitemap", "skip to content")
_STOCK = ("all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "lorem ipsum",
          "enable javascript", "click here", "read more", "subscribe to our newsletter", "powered by")
_STOCK_WORDS = rf"(?i)\b({'|'.join(_STOCK)})\b"
_MARK = "[.!?,;:…。！？，،؟।॥۔؛、；：．｡։።፣။၊།]"


def _phrase_share(text: str) -> str:
    """Words of stock phrases for each word of a text."""
    return (rf"len(regexp_extract_all(array_to_string(regexp_extract_all({text}, '{_STOCK_WORDS}'), ' '), '[^ ]+')) / "
            rf"CAST(greatest(len(regexp_extract_all({text}, '{_SPACED}')), 1) AS DOUBLE)")


OP2 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{_SPACED}') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five
            FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM worded WHERE len(w) >= 5)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM repeated) GROUP BY r),
all_lines AS (SELECT r, i, line, regexp_extract_all(line, '{_SPACED}') AS w, len(regexp_replace(line, '[\x20\x09-\x0D]+$', '')) AS width
              FROM (SELECT r, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i
                    FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs))),
neighbours AS (SELECT *, lag(width) OVER up AS upper_width, lag(w) OVER up AS upper FROM all_lines WINDOW up AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT r, i, greatest(width, upper_width) AS low, upper_width + 1 + len(w[1]) AS high,
                 NOT regexp_matches(right(upper[-1], 1), '{_MARK}') AND regexp_matches(w[1], '^\p{{Ll}}') AS goes_on
          FROM neighbours WHERE len(w) > 0 AND len(upper) > 0 AND greatest(width, upper_width) < upper_width + 1 + len(w[1])),
told AS (SELECT a.r, a.low, count(*) AS n FROM (SELECT DISTINCT r, low FROM pairs) a JOIN pairs b ON a.r = b.r AND b.low <= a.low AND a.low < b.high
         GROUP BY a.r, a.low),
fitted AS (SELECT r, low AS width FROM told WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, low) = 1),
cut AS (SELECT l.r, l.i, l.line, l.w, coalesce(p.goes_on, false) AS goes_on,
               coalesce(p.goes_on OR f.width >= p.low AND f.width < p.high, false) AS one
        FROM all_lines l LEFT JOIN pairs p ON p.r = l.r AND p.i = l.i LEFT JOIN fitted f ON f.r = l.r),
pieces AS (SELECT *, count(*) FILTER (WHERE NOT one) OVER (PARTITION BY r ORDER BY i) AS paragraph,
                  count(*) FILTER (WHERE NOT goes_on) OVER (PARTITION BY r ORDER BY i) AS sentence FROM cut),
lines AS (SELECT *, bool_or(regexp_matches(line, '{_MARK}')) OVER (PARTITION BY r, paragraph) AS marked FROM pieces),
sentences AS (SELECT r, sentence, string_agg(line, ' ' ORDER BY i) AS whole FROM pieces
              WHERE (r, sentence) IN (SELECT (r, sentence) FROM pieces WHERE regexp_matches(line, '{_STOCK_WORDS}')) GROUP BY r, sentence),
measured AS (
  SELECT l.r, len(w) AS n, len(replace(array_to_string(w, ''), ' ', '')) AS chars, marked,
         row_number() OVER (PARTITION BY l.r, line ORDER BY i) > 1 AS earlier, line, whole,
         len(list_filter(w, lambda x: x IN ('|', '>', '>>', '»', '•', '·', '/', '→'))) AS seps,
         lower(trim(array_to_string(w, ' '), '.:!')) AS menu,
         2 * len(array_to_string(regexp_extract_all(array_to_string(w, ''), '[\x{{0E00}}-\x{{0EFF}}]'), '')) >= len(array_to_string(w, '')) AS unmarked_script,
         len(array_to_string(regexp_extract_all(line, '[#*$%&|<>~^=_{{}}\\]|!{{2,}}|\?{{2,}}|\.{{4,}}|-{{3,}}'), '')) AS marks
  FROM lines l LEFT JOIN sentences s ON s.r = l.r AND s.sentence = l.sentence WHERE len(w) > 0),
ruled AS (
  SELECT r, chars, earlier, CASE
    WHEN seps >= 2 AND seps >= 0.15 * n THEN 'navigation'
    WHEN n <= 4 AND menu IN ({_list(_MENU)}) THEN 'navigation'
    WHEN marks >= 2 AND marks > 0.10 * chars THEN 'punctuation'
    WHEN n >= 12 AND NOT marked AND NOT unmarked_script THEN 'punctuation'
    WHEN earlier OR whole IS NOT NULL AND regexp_matches(line, '{_STOCK_WORDS}')
         AND least({_phrase_share('line')}, {_phrase_share('whole')}) >= 0.30 THEN 'boilerplate' END AS rule
  FROM measured),
summed AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE earlier) AS n_dup_lines,
         count(*) FILTER (WHERE rule = 'punctuation') AS n_punctuation, count(*) FILTER (WHERE rule = 'navigation') AS n_navigation,
         count(*) FILTER (WHERE rule = 'boilerplate') AS n_boilerplate, coalesce(sum(chars) FILTER (WHERE rule IS NOT NULL), 0) AS lost
  FROM ruled GROUP BY r),
based AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(array_to_string(d.w, '')), 0) AS word_chars,
         len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(s.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_punctuation, 0) AS n_punctuation,
         coalesce(s.n_navigation, 0) AS n_navigation, coalesce(s.n_boilerplate, 0) AS n_boilerplate, coalesce(s.lost, 0) AS lost
  FROM worded d LEFT JOIN covered c USING (r) LEFT JOIN summed s USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lost_share <= 0.30 AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_punctuation AS BIGINT) AS n_punctuation, CAST(n_navigation AS BIGINT) AS n_navigation,
       CAST(n_boilerplate AS BIGINT) AS n_boilerplate, lost_share
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN CAST(lost AS DOUBLE) / word_chars ELSE 0.0 END AS lost_share FROM based)"""


# Fixed values of the licence scan, written out here: digests of the known canonical forms, spellings of one word, and the words
# behind "copyright" that make it no notice.
_DIGESTS = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("Apache-2.0", "28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6"),
    ("Apache-2.0", "eff9e05c9de2ebaf67a47336fef7135676ea38a388048f3f843195d9ee4d2e77"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "4af76f6b1905a1186b51e0941ebeff988b0a3e53ec61a8b9d91a93a67097e825"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("CC-BY-4.0", "5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2"),
    ("CC-BY-NC-4.0", "e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16"),
    ("CC-BY-SA-4.0", "2b112a6fd54caf2eae8e23516b628ad8ac20c00e407e568c503a16ef1eabaec2"),
    ("CC0-1.0", "8a28c6c22cb111ee16c49159c448a6149c87932bac943eb9a4d15a1884ec0440"),
    ("GPL-3.0", "37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5"),
    ("GPL-3.0", "86cc14fde51d648e1d084ecc39341eefd11fedf263aba490c5b70924ca271986"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("MIT", "00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6574b7ebe0cb585e9b2f2c05d1e04a3181922d9bf36edf6c9f6a3cba7bac1564"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "d1ce9579b2c8d32b706b421d9c42208152298e00849e57ce7da8e906ed3802f2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50"),
    ("LGPL-2.1", "6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
_SPELLED = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willfull",
    "noncommercial": "non commercial", "sublicence": "sublicense", "https": "http",
}
_NO_NOTICE = ("(notice|notices|holder|holders|owner|owners|owned|ownership|licence|licences|license|licenses|licenced|licensed|law|laws|statement|"
              "statements|interest|interests|disclaimer|disclaimers|protection|right|rights|treaty|patent|patents|and|or|in|is|of|on|to|for|as|"
              r"that|which|you|if|any)\b")
_HEAD = r"^[^a-z0-9\n]*"


def _lines_kept(column: str) -> str:
    """SQL of the lower-cased lines, those that are notices or reserve all rights made empty. A line is looked at with the one behind it."""
    notice = (rf"(regexp_matches(l[1], '{_HEAD}©') OR regexp_matches(l[1], '{_HEAD}copyright') AND NOT regexp_matches(l[1] || chr(10) || coalesce(l[2], ''), "
              rf"'{_HEAD}copyright[^a-z0-9]*{_NO_NOTICE}') OR regexp_matches(l[1], '{_HEAD}\(c\)') AND NOT regexp_matches(l[1], '{_HEAD}\(c\) *{_NO_NOTICE}'))")
    reserved = rf"regexp_matches(l[1], '{_HEAD}all rights reserved[^a-z0-9]*$')"
    lines = f"string_split(lower(coalesce({column}, '')), chr(10))"
    return f"list_transform(list_zip({lines}, {lines}[2:]), lambda l: CASE WHEN {notice} OR {reserved} THEN '' ELSE l[1] END)"


def _canonical(column: str) -> str:
    """SQL of the canonical form with lines still apart."""
    plain = (rf"regexp_replace(array_to_string({_lines_kept(column)}, chr(10)), "
             r"'[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’‚“”„–—‐‑]+', ' ', 'g')")
    spelled = f"map([{_list(_SPELLED)}], [{_list(_SPELLED.values())}])"
    return (f"array_to_string(list_transform(string_split(replace({plain}, chr(10), ' ' || chr(10) || ' '), ' '), "
            f"lambda x: coalesce({spelled}[x], x)), ' ')")


_JOINED = r"trim(replace(' ' || trim(regexp_replace({0}, '[ \n]+', ' ', 'g')) || ' ', ' sub license ', ' sublicense '))"
OP4 = rf"""
WITH known AS (SELECT digest, min(license_id) AS license_id
               FROM (VALUES {", ".join(f"({_text(i)}, {_text(d)})" for i, d in _DIGESTS)}) AS t(license_id, digest) GROUP BY 1),
forms AS (SELECT doc_id, {_canonical('text')} AS form FROM documents),
docs AS (SELECT DISTINCT doc_id, {_JOINED.format('form')} AS entire, form FROM forms),
units AS (SELECT DISTINCT doc_id, entire, {_JOINED.format('part')} AS part
          FROM (SELECT doc_id, entire, unnest(list_concat(string_split(form, chr(10)),
                       regexp_split_to_array(form, '\n[ \n]*\n'))) AS part FROM docs)),
found AS (SELECT u.doc_id, u.entire, k.license_id FROM units u JOIN known k ON sha256(u.part) = k.digest WHERE u.part <> u.entire)
SELECT d.doc_id, sha256(d.entire) AS text_digest, k.license_id, coalesce(f.n, 0) AS n_notices, coalesce(f.ids, '') AS notice_ids
FROM (SELECT DISTINCT doc_id, entire FROM docs) d LEFT JOIN known k ON sha256(d.entire) = k.digest
LEFT JOIN (SELECT doc_id, entire, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS ids
           FROM found GROUP BY 1, 2) f ON f.doc_id = d.doc_id AND f.entire = d.entire"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UP + "', '" + _LOW + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
                  FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
windows AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
                  FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item FROM windows v JOIN phrases p ON p.n = v.n AND p.phrase = v.phrase),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)"""


# Fixed values of the chat template: its control strings.
_CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
             "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<pad>", "<unk>", "[PAD]")


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in _CONTROLS:
        out = f"replace({out}, {_text(c)}, {_text(c[0] + chr(92) + c[1:])})"
    return out


OP9 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(len({_escaped('role')}) + len({_escaped('text')}) + len('<|turn|><|text|><|end|>')) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(len(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM told"""

OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
                FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                                                                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM starts) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
         FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates)),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, h.a AS l, t.a AS r,
                  CAST((2000000::HUGEINT * c.a) // (h.a::HUGEINT + t.a) AS BIGINT) AS score
           FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
                  FROM (SELECT lang, a, w, m, unnest(generate_series(1, k - m + 1)) AS i
                        FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM candidates))),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_phrases i USING (lang, phrase) WHERE 100 * i.a >= 80 * c.a)
SELECT * FROM (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, n, score
               FROM lowest s JOIN totals USING (lang) ANTI JOIN dropped d ON d.lang = s.lang AND d.phrase = s.phrase)
WHERE rank <= 2000"""

ORACLE = {"op12_phrases": OP12, "op2_quality_rules": OP2, "op4_license_scan": OP4, "op5_decontaminate": OP5, "op9_chat_format": OP9}
