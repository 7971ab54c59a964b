"""Masking of personal data as column expressions (Java patterns, Unicode classes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USER, NAME = "{사용자 id}", "{사용자 이름}"

#: Fixed patterns, as the rules for masking state them; results must equal those of systems that mask by the same rules.
#: An e-mail address: name, at sign, dotted domain with a last label of two letters or more.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Endings after the dot that are files, domains or technical names, not accounts.
NOT_ACCOUNT = (
    "py sh bash md yml yaml json log txt csv tsv sql html htm js jsx ts tsx css svg png jpg jpeg gif pdf xlsx xls doc docx "
    "ppt pptx zip tar gz bz2 xz whl deb rpm img iso bin so out err lock toml xml cfg conf ini env example bak tmp old new "
    "sample template pem crt key pub service socket timer list path sys db dat dump hwp hwpx msg eml jar war exe bat cmd ps1 "
    "com net org io kr co jp cn us eu ai app cloud gov edu ac info biz local internal dev test stage prod"
).split()
#: Fixed pattern: a word of 2 to 16, a dot and a word of 2 to 31, not part of a longer dotted token. \w takes Hangul too, so a particle right after ends the match.
ACCOUNT = r"(?U)(?<![.A-Za-z0-9_-])(?<!\w)[A-Za-z][A-Za-z0-9_-]{1,15}\.(?!(?i:" + "|".join(NOT_ACCOUNT) + r")(?![\w-]))[A-Za-z][A-Za-z0-9_-]{1,30}(?!\.?[\w-])"
#: Fixed pattern: an address, from its scheme or www. to white space, quote, angle or closing bracket; what it holds is no account.
ADDRESS = r"(?:[A-Za-z][A-Za-z0-9+.\-]*://|www\.)[^\s<>\"')\]]+"

#: Surnames, titles, labels before a name, and organisation endings.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구라마원방변석선설소엄여염용육인제진천추탁태편표피함현형"
TITLES = "님 씨 책임 선임 수석 프로 사원 주임 대리 과장 차장 부장 팀장 파트장 그룹장 매니저 연구원".split()
LABELS = "담당자 요청자 의뢰자 작성자 신청자 문의자 처리자 승인자 성명 이름".split()
ORGANISATIONS = "사업부 본부 부문 센터 그룹 파트 모듈 부서 팀".split()

#: Fixed patterns: a surname and one or two syllables before a title; a label, colon and one or two words of up to 12 letters;
#: up to 15 letters and an organisation's ending, where the word ends or a particle follows.
TITLED = rf"(?<![가-힣])[{SURNAMES}][가-힣]{{1,2}}(?=\s*({'|'.join(TITLES)}))"
LABELLED = rf"({'|'.join(LABELS)})\s*[:：]\s*[A-Za-z가-힣]{{1,12}}(?:\s+[A-Za-z가-힣]{{1,12}})?"
ORGANISATION = rf"[A-Za-z가-힣0-9]{{0,15}}?({'|'.join(ORGANISATIONS)})(?=$|[^A-Za-z0-9가-힣]|[은는이가을를의에도만과와로])"


def _outside_addresses(t: Column, change) -> Column:
    """Applies ``change`` between addresses only.

    The text is cut where an address starts and ends; at a cut, characters of
    the neighbouring piece stay visible as a mark so that look-around holds.
    """
    addresses = F.regexp_extract_all(t, F.lit(f"({ADDRESS})"), F.lit(1))
    masked = F.transform(F.split(t, ADDRESS, -1), change)
    apart = F.array_join(F.zip_with(masked, addresses, lambda x, a: F.concat(x, F.coalesce(a, F.lit("")))), "")
    return F.when(F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), apart).otherwise(change(t))


def mask_email(t: Column) -> Column:
    return F.regexp_replace(t, EMAIL, _quoted(USER))


def _quoted(x: str) -> str:
    return x.replace("\\", "\\\\").replace("$", "\\$")


def mask_accounts(t: Column) -> Column:
    """E-mail addresses and accounts; names and organisations stay."""
    return _outside_addresses(mask_email(t), lambda x: F.regexp_replace(x, ACCOUNT, _quoted(USER)))


def mask_pii(t: Column) -> Column:
    """Accounts, then labelled names, names before a title, and organisations."""
    own = mask_accounts(t)
    named = F.regexp_replace(F.regexp_replace(own, LABELLED, "$1: " + _quoted(NAME)), TITLED, _quoted(NAME))
    # what the text's own letters rule out is not searched for
    return F.when(~t.rlike("[가-힣]"), own).otherwise(F.regexp_replace(named, ORGANISATION, "{$1명}"))


def find_accounts(t: Column) -> Column:
    """Distinct accounts outside addresses, in order."""
    rest = F.array_join(F.split(F.coalesce(t, F.lit("")), ADDRESS, -1), " ")
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(f"({ACCOUNT})"), F.lit(1)))


def mask_fields(df, *fields: str):
    """``df`` with the named text columns masked."""
    return df.withColumns({f: mask_pii(F.col(f)) for f in fields if f in df.columns})


def mask_secret(is_secret: Column, value: Column) -> Column:
    """Bullets and the last four characters; four bullets for four or fewer."""
    long = F.concat(F.repeat(F.lit("•"), 8), F.right(value, F.lit(4)))
    return F.when(~is_secret | (value == "") | value.isNull(), value).when(F.length(value) <= 4, F.lit("••••")).otherwise(long)
