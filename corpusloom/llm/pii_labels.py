"""Labelled spans for training the personal-data tagger: fixed values.

Each pattern knows the sentence or label around a piece of personal data and marks the piece as its group.
They label the bounded training sample only; the tagger itself never sees them.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

_MAIL = r"[A-Za-z0-9][A-Za-z0-9._+-]*(?:@|(?<=\w) @ |\s?[\[(]at[\])]\s?|\sAT\s|\s(?:arobase|arroba)\s)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sDOT\s|\s(?:point|punto|punkt)\s)[A-Za-z0-9-]+)*"
_TEL = r"[+(（\d][\d ().（）/+-]*\d"
_ID = r"[A-Z0-9](?:[A-Z0-9]| (?=[A-Z0-9])|[.-](?=[A-Z0-9]))*"
_LAT = "A-Za-zÀ-ÖØ-öø-ÿ"
_NAME = rf"(?:[A-ZÀ-ÖØ-Þ][{_LAT}'’.-]*,? ){{1,4}}[A-ZÀ-ÖØ-Þ][{_LAT}'’-]*"
_HAN = r"[一-鿿]{2,4}"
_JA = r"[一-鿿ヶノ々]{2,4} ?[一-鿿]{1,3}"

PATTERNS = {
    "email": [rf"(?<![A-Za-z0-9._+-])({_MAIL})(?<=[A-Za-z])(?=[^A-Za-z0-9-]|$)"],
    "phone": [
        rf"(?:Call|Text me on|tel:|Phone:|Tel\.:?|Telefon:|Tél\. ?:|Téléphone :|Teléfono:|Móvil:|The desk \(|手机：|电话：|请致电|お電話は|電話：|携帯：|Appelez le|Llame al|Telefonisch unter) ?({_TEL})(?=\)? is staffed|[^\d-]|$)",
        rf" \| ({_TEL}) \| ",
    ],
    "id_number": [
        rf"(?:ID given at the door was|national insurance no\. is|Passport|SSN:|NIN:|ID:|social security number|DNI:?|NIE:?|Pasaporte:?|Steuer-ID:?|Ausweisnummer:|Personalausweis|Reisepass|Numéro de sécurité sociale :|Passeport :?|Carte d'identité :?|マイナンバーは|マイナンバー：|旅券番号：|旅券番号は|身份证号：?|证件号码：|护照号：?|护照) ?({_ID})(?=[^A-Za-z0-9]|$)",
    ],
    "street_address": [
        r"(?:Address: |Adresse : |Dirección: |Anschrift: |住址：|住所：)([^\n|]+?)[.。]?(?=\n|$)",
        r"(?:They moved to )([^\n]+?)(?= last spring)",
        r"(?:The parcel goes to |Visitors ring the bell at |El paquete va a |Le colis part au |Post bitte an )([^\n]+?)(?<!str)\.(?=\s|$)",
        r"包裹寄往([^\n]+?)。",
        r"送り先は([^\n]+?)です",
        r" \| [^|\n]*\d[^|\n]* \| ([^|\n]+?)(?=\n|$)",
    ],
    "person_name": [
        rf"(?:Reviewed by: |Gez\. |Firmado: |Signé : |Geprüft von: |Relu par : |Revisado por: )(?:Dr\.? |Mr\.? |Ms\.? |Mrs\.? |Prof\.? |Frau |Herrn? |Mme |M\. |Sra?\. )?({_NAME})(?=\n|$)",
        rf"(?:Thanks go to |Please ask |The last note came from |Gracias a |Merci à |Rückfragen bitte an )(?:Dr\.? |Mr\.? |Ms\.? |Mrs\.? |Prof\.? |Frau |Herrn? |Mme |M\. |Sra?\. |D\. |Dña\. )?({_NAME})(?= for the second| before you|, who had| por la rev| pour la rel|\.)",
        rf"(?:^|(?<=[.!?] )|(?<=\n))(?:Dr\.? |Mr\.? |Ms\.? |Mrs\.? |Prof\.? |Frau |Herrn? |Herr |Mme |M\. |Sra?\. )?({_NAME})(?:(?='s copy was)|(?= signed the rev)|(?= firmó la hoja)|(?= a signé la feuille)|(?= unterschrieb das))",
        rf"(?:^|(?<=\n))({_NAME})(?= \| )",
        rf"^[—–-] ({_NAME})(?=\n|$)",
        rf"^[—–-] ?({_HAN}|{_JA})(?=\n|$)",
        rf"感谢({_HAN})的二次审读",
        rf"(?:^|(?<=[。\n]))({_HAN})(?=在表格上签了名|(?:女士|先生)中午之前)",
        rf"(?:^|(?<=\n))({_HAN})(?= \| )",
        rf"(?:审核人|审读人|联系人|校对)：({_HAN})(?=\n|$)",
        rf"(?:^|(?<=[。\n]))({_JA})(?=氏の確認|さんが用紙|さん|氏)",
        rf"(?:担当|校閲|確認者|査読者)：({_JA})(?=\n|$)",
        rf"(?:^|(?<=\n))({_JA})(?= \| )",
    ],
}
COMPILED = {k: [re.compile(p, re.M) for p in v] for k, v in PATTERNS.items()}


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the labelled spans, none overlapping; the first kind wins."""
    out: list[tuple[int, int, int]] = []
    for i, kind in enumerate(KINDS):
        for p in COMPILED[kind]:
            for m in p.finditer(text):
                a, b = m.span(1)
                if kind in ("phone", "id_number") and sum(c.isdigit() for c in m[1]) < 5:
                    continue
                if kind == "street_address" and not any(c.isdigit() for c in m[1]):
                    continue
                if all(b <= x or a >= y for x, y, _ in out):
                    out.append((a, b, i))
    return sorted(out)
