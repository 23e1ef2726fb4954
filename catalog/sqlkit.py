"""SQL spellings of the shared contracts for the DuckDB side (RE2: no look-behind, ASCII \\s)."""

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FINALS = ".!?。！？।؟።"


def strip(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def k1(c):
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def k2(c):
    return f"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"


def h32(seed, *key):
    parts = " || ':' || ".join(f"({k})::VARCHAR" for k in key)
    return f"('0x' || substr(md5('{seed}:' || {parts}), 1, 8))::BIGINT"


def u(seed, *key):
    return f"({h32(seed, *key)} / 4294967296.0)"


def pick(seed, key, n):
    return f"({h32(seed, key)} % ({n}))"


def sents(c, lo=1, hi=None):
    """List of stripped sentences with length bounds."""
    marked = rf"regexp_replace(regexp_replace({c}, '([{FINALS}])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    cond = f"length(s) >= {lo}" + (f" and length(s) <= {hi}" if hi is not None else "")
    return f"[s for s in [{strip('p')} for p in string_split({marked}, chr(1))] if {cond}]"


def md5_mod(c, n):
    r = "0::BIGINT"
    for i in range(4):
        r = f"(({r} * 4294967296 + ('0x' || substr(md5({c}), {1 + 8 * i}, 8))::BIGINT) % {n})"
    return r
