"""SQL fragments shared by the check queries (DuckDB dialect)."""

# White space as in passagework.functions.text.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def non_blank(expr: str) -> str:
    """Stripped, non-empty elements of a list."""
    return f"list_filter(list_transform({expr}, lambda s: {strip('s')}), lambda s: s <> '')"


def split_on(expr: str, pattern: str, keep: str = r"\1") -> str:
    """Split behind group 1 of a pattern (stands in for a look-behind)."""
    return rf"string_split(regexp_replace({expr}, '{pattern}', '{keep}' || chr(1), 'g'), chr(1))"


def sentences(expr: str) -> str:
    return non_blank(split_on(expr, rf"([。！？.!?\n]){WS}*"))


def paragraphs(expr: str) -> str:
    return non_blank(
        rf"string_split(regexp_replace({strip(expr)}, '\n{WS}*\n', chr(1), 'g'), chr(1))"
    )


CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"


def tokens(expr: str, fold: bool = True) -> str:
    """Letter and digit runs; CJK runs, cut off from others by a blank, as overlapping bigrams."""
    text = f"lower({expr})" if fold else expr
    parted = rf"regexp_replace({text}, '([{CJK}]+)', ' \1 ', 'g')"
    runs = rf"regexp_extract_all({parted}, '[\p{{L}}\p{{N}}]+')"
    grams = "list_transform(range(1, length(r)), lambda i: substr(r, i::BIGINT, 2))"
    cut = f"list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '[{CJK}]') AND length(r) >= 2 THEN {grams} ELSE [r] END)"
    return f"flatten({cut})"


def long_tokens(expr: str, fold: bool = True) -> str:
    return f"list_distinct(list_filter({tokens(expr, fold)}, lambda t: length(t) > 1))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def cosine(a: str, b: str) -> str:
    return (
        f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 0)"
    )


def phrases(expr: str, words) -> str:
    tests = " OR ".join(f"contains(lower({expr}), '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in words)
    return f"coalesce({tests}, false)"


def values(rows, *names: str, alias: str = "v") -> str:
    """A VALUES list as a derived table."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return repr(x)
        return "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"
