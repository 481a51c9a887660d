"""Pieces of DuckDB SQL for the checks, written against RE2 and list functions, independent of the Column functions."""

from __future__ import annotations

WHITE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PLACEHOLDERS = ["{", "}", "<", ">", "${", "yourhub", "yourdomain", "yourcompany", "example.com", "window.location", "author.email", "url.com"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITE}', ' ', 'g'))"


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def lines(x: str) -> str:
    return rf"string_split(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))"


def unique(x: str, n: int) -> str:
    """First line of each key, as a list of at most n."""
    keys = f"list_transform({x}, lambda v: {key('v')})"
    picked = f"list_filter(list_zip({x}, {keys}, range(1, len({x}) + 1)), lambda e: e[2] <> '' AND list_position({keys}, e[2]) = e[3])"
    return f"list_transform({picked}, lambda e: {norm('e[1]')})[1:{n}]"


def slug(x: str) -> str:
    return f"coalesce(nullif(left(lower(trim(regexp_replace({x}, '[^A-Za-z0-9]+', '-', 'g'), '-')), 120), ''), 'item')"


def display_title(x: str) -> str:
    flat = norm(f"replace(replace({x}, '`', ''''), '|', ' ')")
    cased = f"array_to_string(list_transform(regexp_extract_all(replace(regexp_replace(lower({flat}), '^\\d+-', ''), '-', ' '), '[a-z]+|[^a-z]+'), lambda r: upper(left(r, 1)) || substr(r, 2)), '')"
    return f"coalesce(nullif(left(CASE WHEN regexp_full_match(lower({flat}), '\\d+-[a-z0-9-]+') THEN {cased} ELSE {flat} END, 160), ''), 'Untitled')"


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[A-Za-z0-9]{{3,}}'))"


def unescape(x: str) -> str:
    for a, b in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def html_text(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    return norm(unescape(bare))


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"


def strip(x: str) -> str:
    return f"""rtrim({x}, '.,;:)]}}`"''')"""


def clean_url(x: str) -> str:
    u = strip(f"trim({x})")
    place = f"regexp_extract({u}, '^https?://([^/?#]*)', 1)"
    bad = " OR ".join(f"contains(lower({u}), {q(p)})" for p in PLACEHOLDERS)
    return f"CASE WHEN regexp_matches({u}, '^https?://') AND NOT ({bad}) AND NOT regexp_matches({u}, '[ \\n`]') AND contains({place}, '.') AND NOT ends_with({place}, '.internal') THEN {u} END"


def article_id(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i)/article/(\\d{{4,8}})(?:[/?#].*)?$', 1), '')"


def known_article(x: str) -> str:
    return f"CASE WHEN {article_id(x)} IS NOT NULL THEN regexp_extract({x}, '^(https?://[^/?#]*)', 1) || '/article/' || {article_id(x)} ELSE string_split({x}, '#')[1] END"


def special(x: str) -> str:
    h = host(x)
    return f"CASE WHEN starts_with({h}, 'docs.google.com') OR starts_with({h}, 'drive.google.com') THEN 'needs-google-drive' WHEN {h} IN ('wiki.legacy.test.org') THEN 'stale-doc-reference' WHEN contains({h}, 'confluence.') OR contains({h}, 'zendesk.com') THEN 'likely-auth-gated' END"


def noise(x: str) -> str:
    n = norm(x)
    return f"({n} = '' OR regexp_full_match({n}, '(?i)(pleasesign into comment|comments|posted|sign in|log in|login)') OR starts_with(lower({n}), '*source:*'))"


def imported(x: str) -> str:
    flat = f"replace({x}, chr(13) || chr(10), chr(10))"
    rule = "chr(10) || '---' || chr(10)"
    at = f"instr({flat}, {rule})"
    body = f"CASE WHEN {at} > 0 AND contains(left({flat}, {at} - 1), '*Source:*') THEN substr({flat}, {at} + 5) ELSE {flat} END"
    return f"trim(array_to_string(list_filter(list_transform({lines(body)}, lambda s: rtrim(s)), lambda s: NOT {noise('s')}), chr(10)))"
