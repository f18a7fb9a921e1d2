"""URL expressions: splitting, resolving against a base, hosts and query parameter names.

Everything is an expression over built-ins. The longer ones are Spark SQL text (``*_sql``), so that they can
be used on columns as well as on the elements of an array; ``parse_url`` is not used because it drops ports and
user info, returns NULL for hosts with underscores and raises on spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions import patterns as P
from webcorpus.functions.text_sql import let, one_of, quoted

_CONTROL_OR_SPACE = "".join(chr(c) for c in range(0x21))
_TO_REMOVE = "\t\r\n"


def strip_space(text: Column) -> Column:
    """Strip all white space at both ends (``trim`` only strips spaces)."""
    return F.regexp_replace(text, P.STRIP_SPACE, "")


def clean_url(url: Column) -> Column:
    """Drop leading control characters and all tabs and line breaks, as URL parsers do."""
    return F.translate(F.ltrim(url, F.lit(_CONTROL_OR_SPACE)), _TO_REMOVE, "")


def scheme(clean: Column) -> Column:
    return F.lower(F.regexp_extract(clean, P.SCHEME, 1))


def netloc(clean: Column) -> Column:
    return F.regexp_extract(clean, P.URL_PARTS, 1)


def path(clean: Column) -> Column:
    """Path with its ``;parameters``."""
    return F.regexp_extract(clean, P.URL_PARTS, 2)


def query(clean: Column) -> Column:
    return F.regexp_extract(clean, P.URL_PARTS, 3)


def fragment(clean: Column) -> Column:
    return F.regexp_extract(clean, P.URL_PARTS, 4)


def path_without_params(clean: Column) -> Column:
    """Path with the parameters of its last segment cut off, for schemes that have parameters."""
    whole = path(clean)
    return F.when(
        scheme(clean).isin(*P.PARAM_SCHEMES) & F.contains(whole, F.lit(";")),
        F.regexp_extract(whole, P.PATH_PARAMS, 1),
    ).otherwise(whole)


def domain(url: Column) -> Column:
    """Host in lower case, user info and port included."""
    return F.lower(netloc(clean_url(url)))


def root_domain(url: Column) -> Column:
    """Last two dot-separated labels of the host (no public-suffix list)."""
    host = domain(url)
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2)).otherwise(host)


def base_of(url: Column) -> Column:
    """``scheme://host``."""
    clean = clean_url(url)
    return F.concat(scheme(clean), F.lit("://"), netloc(clean))


def has_web_scheme(url: Column) -> Column:
    return scheme(clean_url(url)).isin("http", "https")


def is_static_asset(url: Column) -> Column:
    alternatives = "|".join(suffix[1:] for suffix in P.STATIC_SUFFIXES)
    return F.lower(path_without_params(clean_url(url))).rlike(rf"\.(?:{alternatives})\z")


def clean_param_name(name: Column) -> Column:
    return F.regexp_replace(name, P.NOT_IN_PARAM_NAMES, "")


def capture_key(url: Column, cut: int | None = None) -> Column:
    """File-name form of a URL: no scheme, ``_`` for ``/``; ``cut`` limits its length."""
    key = F.replace(
        F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")),
        F.lit("/"),
        F.lit("_"),
    )
    return key if cut is None else F.substring(key, 1, cut)


def percent_decode(text: Column, plus_as_space: bool = False) -> Column:
    """Percent-decode, leaving malformed escapes as they are."""
    kept = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_as_space:
        kept = F.replace(kept, F.lit("+"), F.lit("%2B"))
    marks = r"[%+]" if plus_as_space else "%"
    return F.when(text.rlike(marks), F.try_url_decode(kept)).otherwise(text)


def percent_encode(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~/``."""
    encoded = F.url_encode(text)
    for java_form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(java_form), F.lit(wanted))
    return encoded


def param_names(url: Column) -> Column:
    """Distinct parameter names of a URL.

    Names of ``name=value`` pairs of the query with a non-empty value, decoded, and everything that
    looks like ``?name=`` or ``&name=`` anywhere in the URL.
    """
    pairs = F.filter(
        F.split(query(clean_url(url)), "&"), lambda pair: pair.rlike(r"(?s)\A[^=]*+=.")
    )
    named = F.transform(
        pairs, lambda pair: percent_decode(F.substring_index(pair, "=", 1), plus_as_space=True)
    )
    return F.array_union(named, F.regexp_extract_all(url, F.lit(P.URL_PARAM), F.lit(1)))


def clean_url_sql(url: str) -> str:
    return f"translate(ltrim({quoted(_CONTROL_OR_SPACE)}, {url}), {quoted(_TO_REMOVE)}, '')"


def strip_space_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(P.STRIP_SPACE)}, '')"


def _bad_host_sql(host: str) -> str:
    """True where URL parsers refuse the host: broken brackets or delimiter look-alikes."""
    inside = let(
        f"regexp_extract({host}, {quoted(P.BRACKETED)}, 1)",
        "_i",
        f"rlike(_i, {quoted(P.IPV6)}) OR rlike(_i, {quoted(P.IP_FUTURE)})",
    )
    return f"""CASE
        WHEN contains({host}, '[') <> contains({host}, ']') THEN true
        WHEN contains({host}, '[') THEN NOT {inside}
        WHEN rlike({host}, {quoted(P.NOT_ASCII)}) THEN rlike({host}, {quoted(f"[{P.HOST_LOOKALIKES}]")})
        ELSE false END"""


def _pieces_sql(url: str, default_scheme: str = "''") -> str:
    """``struct<s, n, p, m, q, bad>``: scheme, host, path, ``;params``, query and a refusal mark.

    Whether there are parameters depends on the scheme, for a URL without one on ``default_scheme``.
    """
    part = lambda n: f"regexp_extract(_c, {quoted(P.URL_PARTS)}, {n})"
    params = lambda n: f"regexp_extract(_t.w, {quoted(P.PATH_PARAMS)}, {n})"
    split = f"""struct(lower(regexp_extract(_c, {quoted(P.SCHEME)}, 1)) AS s,
        {part(1)} AS n, {part(2)} AS w, {part(3)} AS q)"""
    effective = f"IF(_t.s = '', {default_scheme}, _t.s)"
    has_params = f"contains(_t.w, ';') AND {one_of(effective, P.PARAM_SCHEMES)}"
    cut = f"""struct(_t.s AS s, _t.n AS n, _t.q AS q,
        IF({has_params}, {params(1)}, _t.w) AS p,
        IF({has_params}, {params(2)}, '') AS m,
        {_bad_host_sql('_t.n')} AS bad)"""
    return let(let(clean_url_sql(url), "_c", split), "_t", cut)


def base_parts(url: str) -> Column:
    """What resolving needs to know of the base URL in column ``url``; computed once per page."""
    usable = f"NOT _b.bad AND _b.n <> '' AND _b.s <> '' AND {one_of('_b.s', P.RELATIVE_SCHEMES)}"
    return F.expr(
        let(
            _pieces_sql(url),
            "_b",
            f"""struct({url} AS url, _b.s AS s, _b.n AS n, _b.p AS p, _b.m AS m, _b.q AS q, _b.bad AS bad,
                IF({usable}, concat(_b.s, '://', _b.n), NULL) AS root)""",
        )
    )


def _walk_sql(path: str) -> str:
    """Take ``.`` and ``..`` segments out of a path; one that ends in them keeps its slash."""
    walked = """concat(
        aggregate(_w, cast(array() AS array<string>), (_done, _seg) -> CASE
            WHEN _seg = '..' THEN slice(_done, 1, greatest(size(_done) - 1, 0))
            WHEN _seg = '.' THEN _done
            ELSE array_append(_done, _seg) END),
        IF(element_at(_w, -1) IN ('.', '..'), array(''), cast(array() AS array<string>)))"""
    return let(f"split({path}, '/')", "_w", f"array_join({walked}, '/')")


def _merge_paths_sql(base_path: str, link_path: str) -> str:
    """Path of a reference relative to ``base_path``. Only relative ones lose empty segments."""
    folder = f"regexp_replace({base_path}, {quoted(P.LAST_SEGMENT)}, '')"
    single = lambda text: f"regexp_replace({text}, '/{{2,}}', '/')"
    joined = f"""CASE
        WHEN startswith({link_path}, '/') THEN {link_path}
        WHEN {base_path} = '' THEN {single(f"concat('/', {link_path})")}
        WHEN startswith({base_path}, '/') THEN {single(f"concat({folder}, {link_path})")}
        ELSE {single(f"ltrim('/', concat({folder}, {link_path}))")} END"""
    walked = f"IF(rlike(_j, {quoted(P.DOT_SEGMENT)}), {_walk_sql('_j')}, _j)"
    return let(let(joined, "_j", walked), "_v", "IF(_v = '', '/', _v)")


def _put_together_sql(u: str) -> str:
    tail = f"concat({u}.p, IF({u}.m = '', '', concat(';', {u}.m)))"
    located = f"""CASE
        WHEN {u}.n <> '' THEN
            concat('//', {u}.n, IF(_tail = '' OR startswith(_tail, '/'), '', '/'), _tail)
        WHEN startswith(_tail, '//') THEN concat('//', _tail)
        WHEN {u}.s <> '' AND (_tail = '' OR startswith(_tail, '/')) AND {one_of(f'{u}.s', P.HOST_SCHEMES)}
            THEN concat('//', _tail)
        ELSE _tail END"""
    return f"""concat(IF({u}.s = '', '', concat({u}.s, ':')), {let(tail, '_tail', located)},
        IF({u}.q = '', '', concat('?', {u}.q)))"""


def resolve_sql(link: str, base: str) -> str:
    """Absolute form of ``link`` on a page whose ``base_parts`` are ``base``.

    The fragment is dropped and the result stripped; what URL parsers refuse gives ``""``. Root-relative
    links with nothing to clean (the bulk of a real page) are only glued to the host.
    """
    plain = f"""{base}.root IS NOT NULL AND NOT contains({link}, '/.')
        AND rlike({link}, {quoted(P.PLAIN_ROOT_PATH)})"""
    kind = f"""CASE
        WHEN {base}.url = '' THEN 'own'
        WHEN {link} = '' THEN 'base'
        WHEN {base}.bad OR _o.bad THEN 'bad'
        WHEN (_o.s <> '' AND _o.s <> {base}.s) OR NOT {one_of(f'{base}.s', P.RELATIVE_SCHEMES)} THEN 'own'
        WHEN _o.n <> '' THEN 'absolute'
        WHEN _o.p = '' AND _o.m = '' THEN 'same path'
        ELSE 'merged' END"""
    chosen = f"""struct(
        IF(_k = 'own', _o.s, {base}.s) AS s,
        IF(_k IN ('own', 'absolute'), _o.n, {base}.n) AS n,
        CASE WHEN _k IN ('own', 'absolute') THEN _o.p WHEN _k IN ('base', 'same path') THEN {base}.p
            ELSE {_merge_paths_sql(f'{base}.p', '_o.p')} END AS p,
        IF(_k IN ('base', 'same path'), {base}.m, _o.m) AS m,
        IF(_k = 'base' OR (_k = 'same path' AND _o.q = ''), {base}.q, _o.q) AS q)"""
    result = f"""CASE
        WHEN _k = 'bad' THEN ''
        WHEN _k = 'own' AND NOT contains({link}, '#') THEN {link}
        WHEN _k = 'base' AND NOT contains({base}.url, '#') THEN {base}.url
        WHEN (_k = 'own' AND _o.bad) OR (_k = 'base' AND {base}.bad) THEN ''
        ELSE {let(chosen, '_u', _put_together_sql('_u'))} END"""
    inherited = f"IF({one_of(f'{base}.s', P.RELATIVE_SCHEMES)}, {base}.s, '')"
    full = let(_pieces_sql(link, inherited), "_o", let(kind, "_k", result))
    return f"IF({plain}, concat({base}.root, {link}), {strip_space_sql(full)})"


def resolve(link: str, base: str) -> Column:
    return F.expr(resolve_sql(link, base))
