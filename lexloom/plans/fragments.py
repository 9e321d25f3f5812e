"""SQL fragments (DuckDB) that several reference texts share; each mirrors a function of lexloom.functions.text."""

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def sentences(c: str = "text") -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def lines(c: str = "text") -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


#: doc_id, source, lang, pos (from 0), sent
SENTENCES = f"sents as (select doc_id, source, lang, unnest(range(0, len(s))) as pos, unnest(s) as sent, s from (select doc_id, source, lang, {sentences()} as s from documents))"

#: doc_id, source, lang, pos, at (from 0), token, lc
TOKENS = SENTENCES + f", toks as (select doc_id, source, lang, pos, unnest(range(0, len(t))) as at, unnest(t) as token from (select doc_id, source, lang, pos, {tokens('sent')} as t from sents)), lower_toks as (select *, lower(token) as lc from toks)"

#: word, of the 20 most frequent tokens with five letters or more
KEYWORDS = "keywords as (select lc as word from lower_toks where length(lc) >= 5 group by 1 order by count(*) desc, 1 limit 20)"

#: page (doc_id), seq (from 0), line, of the lines of documents
ENTRIES = f"lines as (select doc_id as page, unnest(range(0, len(l))) as seq, unnest(l) as line from (select doc_id, {lines()} as l from documents))"


def norm(c: str) -> str:
    return squeezed(f"lower(regexp_replace({c}, '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'))")


def norm_sentence(c: str) -> str:
    return squeezed(f"regexp_replace(lower(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')), '[.,!?;:]+$', '')")


def ascii_only(c: str) -> str:
    return f"regexp_replace({c}, '[^ -~]', '', 'g')"
