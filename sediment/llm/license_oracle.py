"""Operator 8 said again, in plain Python and in SQL, without the expressions of ``license_scan``; a check of them."""

from __future__ import annotations

import hashlib
import re

from .license_texts import names, registry

_SIGNED = re.compile(r"[^a-z0-9]*(copyright( \(c\)|:| ©| [0-9<\[{(])|\(c\) *(copyright|[0-9<\[{©])|©|all rights reserved)")
_NAMED = re.compile(r"[^a-z0-9]*(copyright |\(c\) *)([a-z]+\b)?", re.A)
_SIGN = re.compile(r"[^a-z0-9]*(copyright|\(c\)|©)")
_SENTENCE = "notice notices holder holders owner owners law laws license licenses statement statements interest interests and or in is to of as".split()
_MEMBER = "you the under if any all each to in for by representations".split()


def _low(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t: str) -> str:
    t = t.replace("https://", "http ").replace("http://", "http ").replace("licence", "license")
    for a, b in (("sub-licens", "sublicens"), ("non-infring", "noninfring"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("&", " and "), ("per cent", "percent"), ("whilst", "while")):
        t = t.replace(a, b)
    keep = lambda c: c.isascii() and (c.islower() or c.isdigit()) or ord(c) > 0xBF and not 0x2000 <= ord(c) <= 0x206F
    return re.sub(" +", " ", "".join(c if keep(c) else " " for c in t)).strip(" ")


def canonical(t: str | None) -> str:
    kept, last = [], ""
    for line in _low(t or "").split("\n"):
        prose = len(re.findall("[a-z0-9]+", last)) > 8 and not _SIGN.match(last)
        named, last = None if prose else _NAMED.match(line), line
        if not (_SIGNED.match(line) or named and named[2] not in (_MEMBER if named[1][0] == "(" else _SENTENCE)):
            kept.append(line)
    out = words("\n".join(kept))
    for place in ("675 mass ave cambridge ma 02139", "59 temple place suite 330 boston ma 02111 1307", "59 temple place boston ma 02111 1307", *(f"51 franklin st{a}{b} boston ma 02110 1301" for a in ("reet", "") for b in (" fifth floor", ""))):
        out = out.replace(f"{place} usa", "fsf address").replace(place, "fsf address")
    return out


def digest(t: str | None) -> str:
    return hashlib.sha256(canonical(t).encode()).hexdigest()


def sql() -> str:
    texts = {digest(t): i for i, t in registry()}
    known = {words(_low(n)): i for i, n in names()}
    values = lambda d: ", ".join(f"('{a}', '{b}')" for a, b in sorted(d.items()))
    return rf"""
WITH known(digest, license_id) AS (VALUES {values(texts)}), named(name, license) AS (VALUES {values(known)}),
low AS (SELECT row_number() OVER () AS rid, doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents),
kept AS (SELECT rid, doc_id, ls, array_to_string(list_filter(ls, lambda x, i: NOT (
  regexp_matches(x, '^[^a-z0-9]*(copyright( \(c\)|:| ©| [0-9<\[{{(])|\(c\) *(copyright|[0-9<\[{{©])|©|all rights reserved)')
  OR regexp_matches(x, '^[^a-z0-9]*(copyright |\(c\))') AND (i = 1 OR len(regexp_extract_all(ls[i - 1], '[a-z0-9]+')) <= 8 OR regexp_matches(ls[i - 1], '^[^a-z0-9]*(copyright|\(c\)|©)')) AND NOT regexp_matches(x, '^[^a-z0-9]*copyright (notices?|holders?|owners?|laws?|licenses?|statements?|interests?|and|or|in|is|to|of|as)\b')
    AND NOT regexp_matches(x, '^[^a-z0-9]*\(c\) *(you|the|under|if|any|all|each|to|in|for|by|representations)\b'))), chr(10)) AS t FROM low),
lines AS (SELECT rid, unnest(ls) AS t FROM low),
units AS (SELECT rid, 'text' AS part, t FROM kept UNION ALL SELECT rid, 'line', t FROM lines WHERE contains(t, 'under') OR contains(t, 'identifier')),
spelt AS (SELECT rid, part, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'https://', 'http '), 'http://', 'http '), 'licence', 'license'), 'sub-licens', 'sublicens'), 'non-infring', 'noninfring'),
  'merchantibility', 'merchantability'), 'acknowledgement', 'acknowledgment'), 'organisation', 'organization'), '&', ' and '), 'per cent', 'percent'), 'whilst', 'while'),
  '[\x00-\x2f\x3a-\x60\x7b-\x{{bf}}\x{{2000}}-\x{{206f}}]+', ' ', 'g'), ' ') AS w FROM units),
d AS (SELECT rid, sha256(regexp_replace(w, '(675 mass ave cambridge ma 02139|59 temple place( suite 330)? boston ma 02111 1307|51 franklin st(reet)?( fifth floor)? boston ma 02110 1301)( usa)?', 'fsf address', 'g')) AS text_digest FROM spelt WHERE part = 'text'),
said AS (SELECT DISTINCT rid, license FROM spelt JOIN named ON name = regexp_replace(w, '^(spdx license identifier |(this [a-z]+ is )?(licensed|released|distributed|available|published|provided) under (the )?(terms of )?(the )?)', '')
  WHERE part = 'line' AND name <> w),
n AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS notices FROM said GROUP BY rid)
SELECT low.doc_id, d.text_digest, known.license_id, known.license_id IS NOT NULL AS is_license, coalesce(n.notices, '') AS notices
FROM low JOIN d USING (rid) LEFT JOIN n USING (rid) LEFT JOIN known ON d.text_digest = known.digest
"""
