"""PII surrogates: detected entities get keyed, type-consistent replacements, as Spark expressions only.

Detected are e-mail addresses, hexadecimal secrets of 32 digits or more, IBANs, phone numbers, US social security numbers, IPv4 and IPv6
addresses, card numbers of 13 to 19 digits, street addresses, and person names: after a title or an introduction ("my name is", "Dear") in
scripts with capitals; after or before a title or honorific in Arabic, Hebrew, Devanagari, Han, Kana and Hangul.

A replacement keeps the type, length, punctuation and case of numbers and addresses; digits stay digits; a card number passes the Luhn test if
and only if the original does; an IBAN keeps its country and gets right check digits; a phone number keeps its country code and exchange. A name keeps
its script; in scripts with capitals it takes the ending of the gender that most of the word's titles in the corpus have.

One entity has one replacement in all documents (coreference): it depends on type, canonical form, gender and key alone. Names are entities word by
word, so "Mr John Smith", "Dr Smith" and "Dear John" share their words' replacements, whatever the title; phone numbers are equal with and
without the country code 1.
Distinctness is checked over the whole corpus, in rounds: a candidate that another entity already has, or that is itself a real entity
of the corpus, is dealt again. Each round a name may be a syllable longer (45 times as many values), and any entity gets three times as many
candidates, so a round is left over only where a fixed form (nine digits, say) has hardly a value left that the corpus does not hold: after ``MAX_ROUNDS`` such
an entity is masked by a keyed tag that is longer than the form and cannot collide.

Defined results: null texts stay null with 0 entities, empty ones stay empty; null ids stay null; rows with equal id
and text get equal results; where patterns overlap the leftmost match wins, and of those the first in the order of PATTERNS; as many titles of either
gender make a word's gender neutral; a very long text is one row, matched once to find and once to split; other columns pass through (input columns named
``n_entities`` or ``kinds`` are replaced, those that start with ``_pii_`` dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import row_key
from .shared import materialise, read_table

KEY = "nightgrid-surrogates-1"
MAX_ROUNDS = 8
# Titles before a name by gender of the person ("n": either), in scripts with capitals and without.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
CASELESS_TITLES = {"m": ["السيد", "מר", "श्री"], "f": ["السيدة", "גברת", "श्रीमती"], "n": ["الدكتور", "डॉ"]}
# Honorifics after a name.
HONORIFICS = {"m": ["先生"], "f": ["女士", "小姐"], "n": ["さん", "様", "씨", "님"]}
# What a name may follow without a title, and common family names of languages without spaces or capitals.
INTRODUCTIONS = ["[Mm]y name is ", "[Nn]ame: ", "[Ss]igned, ", "[Rr]egards, ", "[Dd]ear "]
HAN_FAMILIES = "王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈"
HANGUL_FAMILIES = "김이박최정강조윤장임한오서신권황안송류홍"
# Syllables that names are made of, by script, with the range that tells the script, and gendered endings.
SYLLABLES = {
    "cyrillic": ("0400-04FF", "ба бе бо ва ве ви га го да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то"),
    "greek": ("0370-03FF", "βα βε γα γε δα δε δι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το"),
    "arabic": ("0600-06FF", "با تا جا دا را سا فا كا لا ما نا بي تي جي دي ري سي في كي لي مي ني بو تو جو دو رو سو فو كو لو مو نو"),
    "hebrew": ("0590-05FF", "בא גא דא זא טא כא לא מא נא סא רא תא בי גי די זי טי כי לי מי ני סי רי תי בו גו דו זו טו כו לו מו נו סו רו תו"),
    "devanagari": ("0900-097F", "का गा जा ता दा ना पा बा मा रा ला वा सा की गी जी ती दी नी पी बी मी री ली वी सी कु गु जु तु दु नु पु बु मु रु लु वु सु"),
    "kana": ("3040-30FF", "か き く け こ さ し す せ そ た ち つ て と な に ぬ ね の は ひ ふ へ ほ ま み む め も ら り る れ ろ"),
    "hangul": ("AC00-D7AF", "가 거 고 구 기 나 너 노 누 니 다 더 도 두 디 라 러 로 루 리 마 머 모 무 미 바 버 보 부 비 사 서 소 수 시 자 저 조 주 지"),
    "han": ("4E00-9FFF", "安 白 柏 冰 波 博 昌 春 达 东 恩 芳 峰 光 海 涵 和 恒 华 慧 佳 建 杰 静 俊 康 兰 乐 丽 亮 玲 龙 美 明 宁 鹏 平 奇 清 蓉 瑞 山 诗 书 涛 天 伟 文 霞 晓 欣 雪 雅 阳 怡 英 勇 宇 远 云 泽 志 忠 子"),
    "latin": ("", "ba be bo da de do fa fi ga go ha jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za"),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "ль"}, "greek": {"m": "ς", "f": "νη", "n": "ν"}}
#: Syllables of a name in the first round.
FIRST_SYLLABLES = 3
_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_CASELESS = "|".join(t for t in sorted((t for g in CASELESS_TITLES.values() for t in g), key=len, reverse=True))
_AFTER = "|".join(t for g in HONORIFICS.values() for t in g)
#: Alternatives in order of preference, each with the type it stands for.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]{0,31}[0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "street": r"(?=[0-9])(?<![0-9])[0-9]{1,5} \p{Lu}\p{L}+(?: \p{Lu}\p{L}+){0,2} (?:Street|Avenue|Road|Lane|Boulevard|Drive|Court)(?![\p{L}])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:{_TITLE})\.? {_WORD}(?: {_WORD}){{0,2}}|(?=\p{{Lu}})(?<={'|'.join(INTRODUCTIONS)}){_WORD}(?: {_WORD}){{0,2}}"
    rf"|(?=[\u0590-\u06FF\u0900-\u097F])(?<![\p{{L}}\p{{M}}])(?:{_CASELESS})\.? [\p{{L}}\p{{M}}]+|[{HAN_FAMILIES}]\p{{IsHan}}{{0,2}}(?:先生|女士|小姐)|\p{{IsHan}}{{1,4}}(?:さん|様)|[{HANGUL_FAMILIES}]\p{{IsHangul}}{{1,2}} ?(?:씨|님)",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern needs a digit, an at sign, a colon pair, a title or an introduction: a quick test that spares most texts the long pattern.
HINT = rf"[0-9@]|::|(?=\p{{Lu}})(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}|(?:{'|'.join(INTRODUCTIONS)})\p{{Lu}}|(?:{_CASELESS})|(?:{_AFTER})"
_HEAD = rf"^(?:(?:{_TITLE}|{_CASELESS})\.? )"
_TAIL = rf" ?(?:{_AFTER})$"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(x: str) -> str:
    """SQL for the type of a match: the first pattern that it is a whole match of; a name where none is (its pattern looks behind)."""
    return "CASE " + " ".join(f"WHEN {x} rlike {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items() if k != "name") + " ELSE 'name' END"


def canonical(kind: str, x: str) -> str:
    """SQL for what two mentions of an entity share: digits of numbers, lower case of the rest, no spaces in an IBAN."""
    return (
        f"CASE WHEN {kind} = 'phone' THEN regexp_replace(regexp_replace({x}, '[^0-9]', ''), '^1([0-9]{{10}})$', '$1') WHEN {kind} IN ('ssn', 'card') THEN regexp_replace({x}, '[^0-9]', '') "
        f"WHEN {kind} = 'iban' THEN replace({x}, ' ', '') ELSE lower({x}) END"
    )


def _gender_of(m: str) -> str:
    """SQL for the gender that a mention's title tells."""
    title = f"regexp_extract({m}, {_sql(_HEAD)}, 0)"
    bare = f"lower(trim(regexp_replace(concat({title}, regexp_extract({m}, {_sql(_TAIL)}, 0)), '[.]', '')))"
    sides = {g: [t.lower() for t in TITLES[g] + CASELESS_TITLES[g] + HONORIFICS[g]] for g in "mf"}
    return "CASE " + " ".join(f"WHEN {bare} IN ({', '.join(map(_sql, v))}) THEN '{g}'" for g, v in sides.items()) + " ELSE 'n' END"


def _byte(h: str, i: str) -> str:
    """SQL for byte ``i`` (from 0) of a 64-digit hash, going round."""
    return f"cast(conv(substr({h}, 1 + 2 * pmod({i}, 32), 2), 16, 10) AS int)"


def _luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of a digit string whose last digit is the check digit."""
    return (
        f"aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + CASE WHEN pmod(length({digits}) - i, 2) = 0 THEN cast(substr({digits}, i, 1) AS int) "
        f"ELSE pmod(2 * cast(substr({digits}, i, 1) AS int), 10) + (2 * cast(substr({digits}, i, 1) AS int)) div 10 END)"
    )


def _mod97(x: str) -> str:
    """SQL for the remainder by 97 of a string whose letters count as 10 to 35."""
    return f"aggregate(sequence(1, length({x})), 0L, (a, i) -> CASE WHEN substr({x}, i, 1) rlike '[0-9]' THEN pmod(a * 10 + cast(substr({x}, i, 1) AS int), 97) ELSE pmod(a * 100 + ascii(substr({x}, i, 1)) - 55, 97) END)"


def candidate(round_: int, key: str) -> Column:
    """The surrogate in canonical form, from columns ``kind``, ``canon``, ``gender`` and ``attempt``."""
    digit, letter = f"cast(pmod({_byte('h', 'i')}, 10) AS string)", f"char(97 + pmod({_byte('h', 'i')}, 26))"
    each = lambda *first: f"array_join(transform(sequence(1, length(canon)), i -> CASE {' '.join(first)} WHEN substr(canon, i, 1) rlike '[0-9]' THEN {digit} WHEN substr(canon, i, 1) rlike '[a-z]' THEN {letter} WHEN substr(canon, i, 1) rlike '[A-Z]' THEN upper({letter}) ELSE substr(canon, i, 1) END), '')"
    hexa = f"array_join(transform(sequence(1, length(canon)), i -> CASE WHEN substr(canon, i, 1) = ':' THEN ':' ELSE substr('0123456789abcdef', 1 + pmod({_byte('h', 'i')}, 16), 1) END), '')"
    email = each("WHEN i > locate('@', canon) AND NOT substr(canon, i) rlike '[.]' THEN substr(canon, i, 1)")  # the top-level domain stays
    octets = f"concat_ws('.', cast(1 + pmod({_byte('h', '0')}, 223) AS string), cast({_byte('h', '1')} AS string), cast({_byte('h', '2')} AS string), cast({_byte('h', '3')} AS string))"
    # ten digits keep the exchange, longer numbers the country code: these name no person
    phone = each("WHEN length(canon) = 10 AND i BETWEEN 4 AND 6 OR length(canon) > 10 AND i <= 2 THEN substr(canon, i, 1)", f"WHEN i = 1 AND length(canon) = 10 THEN cast(2 + pmod({_byte('h', 'i')}, 8) AS string)")
    # each expression sees its inputs as lambda parameters, so that nothing is worked out twice
    let = lambda var, value, inner: f"element_at(transform(array({value}), {var} -> {inner}), 1)"
    body = f"substr({each()}, 1, length(canon) - 1)"
    fixed = f"pmod(10 - pmod({_luhn_sum('concat(b, chr(48))')}, 10), 10)"
    card = let("b", body, f"concat(b, cast(pmod({fixed} + pmod({_luhn_sum('canon')}, 10), 10) AS string))")
    turned = "concat(b, substr(canon, 1, 2), '00')"
    iban = let("b", f"substr({each()}, 5)", f"concat(substr(canon, 1, 2), lpad(cast(98 - {_mod97(turned)} AS string), 2, '0'), b)")
    n = FIRST_SYLLABLES + round_

    def word() -> str:
        out = "CASE "
        for s, (chars, syl) in SYLLABLES.items():
            arr = f"array({', '.join(map(_sql, syl.split()))})"
            pick = ", ".join(f"get({arr}, pmod({_byte('h', str(2 * k))} * 256 + {_byte('h', str(2 * k + 1))}, {len(syl.split())}))" for k in range(n))
            end = "CASE gender " + " ".join(f"WHEN '{g}' THEN {_sql(v)}" for g, v in ENDINGS[s].items()) + " END" if s in ENDINGS else "''"
            test = f"WHEN canon rlike '[\\\\x{{{chars[:4]}}}-\\\\x{{{chars[5:]}}}]' THEN" if chars else "ELSE"
            out += f"{test} concat({pick}, {end}) "
        return out + "END"

    street = f"concat(regexp_replace(substring_index({each()}, ' ', 1), '^0', '1'), ' ', {word()}, ' ', substring_index(canon, ' ', -1))"
    by = (
        f"CASE kind WHEN 'secret' THEN {hexa} WHEN 'ip6' THEN {hexa} WHEN 'ip' THEN {octets} WHEN 'email' THEN {email} WHEN 'phone' THEN {phone} "
        f"WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'name' THEN {word()} WHEN 'street' THEN {street} ELSE {each()} END"
    )
    return F.expr(let("h", f"sha2(cast(concat_ws('\\u001f', {_sql(key)}, '{round_}', cast(attempt AS string), kind, canon) AS binary), 256)", by))


def surrogates(entities: DataFrame, key: str = KEY, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``kind, canon`` (distinct; ``gender`` if known) -> ``kind, canon, surrogate``; no two entities of a kind share one, none is an entity itself."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit("n"))
    left, done = entities, None
    for r in range(max_rounds):
        tries = left.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3**r - 1)))) if r else left.withColumn("attempt", F.lit(0))
        cand = tries.select("kind", "canon", "attempt", candidate(r, key).alias("surrogate"))
        real = entities.select("kind", F.col("canon").alias("surrogate"))
        free = cand.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("x"))
        if r:  # an entity may have won several
            won = won.groupBy("kind", "x.canon").agg(F.min_by("surrogate", F.struct("x.attempt", "surrogate")).alias("surrogate"))
        won = materialise(won.select("kind", "canon" if r else "x.canon", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = materialise(left.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return done
    tag = F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon").cast("binary"), 256), F.lit("]"))
    return done.unionByName(left.select("kind", "canon", tag.alias("surrogate")))


#: SQL that writes a surrogate in the form of the mention ``m``: digits in the mention's places from the right, case and spaces as they were.
RENDER = """
CASE WHEN surrogate LIKE '[%' THEN surrogate
     WHEN kind IN ('phone', 'ssn', 'card') THEN array_join(transform(sequence(1, length(m)), i ->
          CASE WHEN substr(m, i, 1) rlike '[0-9]' AND length(regexp_replace(substr(m, i), '[^0-9]', '')) <= length(surrogate)
               THEN substr(surrogate, 1 + length(surrogate) - length(regexp_replace(substr(m, i), '[^0-9]', '')), 1) ELSE substr(m, i, 1) END), '')
     WHEN kind = 'iban' THEN array_join(transform(sequence(1, length(m)), i -> CASE WHEN substr(m, i, 1) = ' ' THEN ' ' ELSE substr(surrogate, length(replace(substr(m, 1, i), ' ', '')), 1) END), '')
     WHEN m = upper(m) AND m <> lower(m) THEN upper(surrogate)
     WHEN kind = 'street' OR kind = 'name' THEN initcap(surrogate)
     ELSE surrogate END
"""


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the text's entities replaced, ``n_entities`` and ``kinds`` (map of counts by type)."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_pii_")])
    keyed = docs.withColumn("_pii_key", row_key(id_col, text_col)).withColumn("_pii_hint", F.coalesce(F.col(text_col).rlike(HINT), F.lit(False)))
    found = keyed.filter("_pii_hint").select("_pii_key", F.regexp_extract_all(F.col(text_col), F.lit(ALL), F.lit(0)).alias("found")).filter("size(found) > 0")
    found = found.dropDuplicates(["_pii_key"]).select("_pii_key", F.posexplode("found").alias("at", "m")).withColumn("kind", F.expr(kind_of("m")))
    # a name is an entity for each of its words, between what stands before and after them
    name = F.expr("kind = 'name'")
    found = found.withColumns({"head": F.when(name, F.regexp_extract("m", _HEAD, 0)).otherwise(""), "tail": F.when(name, F.regexp_extract("m", _TAIL, 0)).otherwise(""), "gender": F.when(name, F.expr(_gender_of("m"))).otherwise("n")})
    words = F.when(name, F.split(F.expr("substr(m, 1 + length(head), length(m) - length(head) - length(tail))"), " ")).otherwise(F.array("m"))
    found = found.select("_pii_key", "at", "kind", "head", "tail", "gender", F.size(words).alias("n"), F.posexplode(words).alias("j", "m"))
    found = materialise(found.withColumn("canon", F.expr(canonical("kind", "m"))), "mentions")
    gender = F.expr("CASE WHEN count_if(gender = 'f') > count_if(gender = 'm') THEN 'f' WHEN count_if(gender = 'm') > count_if(gender = 'f') THEN 'm' ELSE 'n' END")
    entities = materialise(found.groupBy("kind", "canon").agg(gender.alias("gender")), "entities")
    new = found.join(surrogates(entities, key), ["kind", "canon"]).withColumn("to", F.expr(RENDER))
    piece = F.struct("at", "j", F.expr("concat(CASE WHEN j = 0 THEN head ELSE ' ' END, to, CASE WHEN j = n - 1 THEN tail ELSE '' END)").alias("to"), "kind")
    by_doc = new.groupBy("_pii_key").agg(F.sort_array(F.collect_list(piece)).alias("_pii_new"))
    changed = keyed.filter("_pii_hint").join(by_doc, "_pii_key", "left").withColumn("_pii_parts", F.when(F.col("_pii_new").isNotNull(), F.split(F.col(text_col), ALL)))
    pieces = F.expr("concat(array_join(transform(_pii_new, x -> concat(CASE WHEN x.j = 0 THEN get(_pii_parts, x.at) ELSE '' END, x.to)), ''), element_at(_pii_parts, -1))")
    text = F.when(F.col("_pii_new").isNull(), F.col(text_col)).otherwise(pieces)
    first = "filter(_pii_new, x -> x.j = 0)"
    counts = F.expr("map_from_entries(transform(array_distinct(transform(_pii_new, x -> x.kind)), k -> struct(k, cast(size(filter(_pii_new, x -> x.j = 0 AND x.kind = k)) AS bigint))))")
    out = changed.withColumns({text_col: text, "n_entities": F.coalesce(F.when(F.col("_pii_new").isNotNull(), F.expr(f"size({first})")), F.lit(0)).cast("long"), "kinds": counts})
    same = keyed.filter("NOT _pii_hint").withColumns({"n_entities": F.lit(0).cast("long"), "kinds": F.lit(None).cast("map<string,bigint>")})
    drop = ["_pii_key", "_pii_hint", "_pii_parts", "_pii_new"]
    return out.drop(*drop).unionByName(same.drop(*drop))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_entities(docs)
    count = lambda k: F.coalesce(F.col("kinds")[k], F.lit(0)).cast("long").alias("n_" + k)
    return out.select("doc_id", "n_entities", *[count(k) for k in PATTERNS], "text")
