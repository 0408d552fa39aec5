"""Added spans on texts marked by hand: rows of the documents, and sentences that no generator of the library wrote."""

from __future__ import annotations

import re

from tracemill.llm import pii

#: [[...]] is personal data that the fixed patterns miss; a kind stands before the bar.
MARKED = (
    # from the documents
    "amente ñtaciónta ramiar, [[card|4465758382889437]] [[card|4465758382889437]] ójaga para ció",
    "ionnd andthshties lytion 8007782375593431 reedwh erlyly",
    "erer edan threined ering 8646308210557563 thsh rethtion",
    "Is onntst to the and and 5731080387325255 ndhaou. The it",
    "èchtion réonê et treê de 2123465659789240 eauvitre onmen",
    "ososueñra que elesrrueas 2744757332971694 de. La, mido c",
    # written for this test
    "Please write to [[email|anna.schmidt [at] posteo [dot] de]] before Friday.",
    "Contact: [[email|j.doe(at)example(dot)com]] or come by.",
    "You can reach me under [[email|maria at example dot org]] any time.",
    "My number is [[phone|(415) 555-0132]], ask for Sam.",
    "Call [[phone|415-555-0132]] after six.",
    "Fax [[phone|212.555.0187]] is no longer in use.",
    "Ring [[phone|(030) 555-0199]] or leave a note with the porter.",
    "The meeting is at noon at the old mill, dot matrix printers are sold there.",
    "He looked at the dot on the map and left.",
    "We are at home and she is at work.",
    "Version 10.2.0.1 fixed it, 4.3.2.1.7 did not.",
    "Chapter 3.1.4.1.5 of the manual covers this.",
    "The order 1234567890123456 was shipped on 2021-03-04 12:30.",
    "ISBN 978-3-16-148410-0 is out of print.",
    "Invoice 2020 0001 0002 0003 is overdue, total 1200 400 300.",
    "From 1914 1918 1939 1945 to this day.",
    "Serial 0000111122223333 and checksum 9f86d081884c7d659a2feaa0c55ad015.",
    "Scores: 12 11 10 9, 8 7 6 5, and 21-19 21-17 in the final.",
)


def test_precision_and_recall_on_marked_texts():
    hit = said = true = 0
    for marked in MARKED:
        want, text, at = set(), "", 0
        for m in re.finditer(r"\[\[(\w+)\|(.*?)\]\]", marked):
            text += marked[at : m.start()]
            want.add((len(text), pii.KINDS.index(m[1]), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += marked[at:]
        found = set(pii.detector().added(text, pii.base_spans(text)))
        hit, said, true = hit + len(found & want), said + len(found), true + len(want)
    assert true == 9 and hit / true >= 0.85 and hit / max(1, said) >= 0.9
