"""Rule tables of name normalization. They must equal the reference's for equal results."""

from __future__ import annotations

# Legal forms, taken off the end of a name.
LEGAL_FORMS = (
    "ab ag aktiebolag aktiengesellschaft ao aps as asa bt bv bvba cb cjsc co companies company corp corporation cv eg ev fze gbr"
    " gesellschaft ggmbh gk gmbh inc incorporated jsc kft kg kgaa kk kkt kommanditgesellschaft lda limitada limitata limited llc llp lp"
    " ltd ltda mbh nv nyrt oao ohg ojsc ooo ou oy oyj pao pjsc plc psa pte pty reszvenytarsasag rt sa sagl sarl sas sirketi ska sl slp"
    " slu snc spa spj spk sprl spzoo srl sro ss tmk ua ug unternehmergesellschaft vof zao zrt"
).split()

# Of these, forms of one or two letters are not taken off the start, but for one.
HEAD_FORMS = [f for f in LEGAL_FORMS if len(f) > 2 or f == "ao"]

# Legal forms of several words and what they become.
COMPOUND_FORMS = {
    "ao": ["aktsionernoe obshchestvo"],
    "bt": ["beteti tarsasag"],
    "cjsc": ["closed joint stock company", "zakrytoe aktsionernoe obshchestvo"],
    "gp": ["general partnership"],
    "jsc": ["gu fen you xian gong si", "joint stock company"],
    "kft": ["korlatolt felelossegu tarsasag"],
    "kk": ["kabushiki kaisha"],
    "kkt": ["kozkereseti tarsasag"],
    "llc": ["limited liability", "limited liability company"],
    "llp": ["limited liability partnership"],
    "lp": ["limited partnership"],
    "ltd": ["you xian gong si", "you xian ze ren gong si"],
    "nyrt": ["nyilvanosan mukodo reszvenytarsasag"],
    "ojsc": ["open joint stock company", "otkrytoe aktsionernoe obshchestvo"],
    "ooo": ["obshchestvo s ogranichennoi otvetstvennostiu", "obshchestvo s ogranichennoi otvetstvennostyu"],
    "pjsc": ["public joint stock company", "publichnoe aktsionernoe obshchestvo"],
    "psa": ["prosta spolka akcyjna"],
    "sa": ["sociedad anonima", "societe anonyme", "spolka akcyjna"],
    "sarl": ["sa rl"],
    "sc": ["spolka cywilna"],
    "se": ["spolka europejska"],
    "ska": ["spolka komandytowo akcyjna", "spolka komandytowoakcyjna"],
    "sl": ["sociedad limitada"],
    "spj": ["spolka jawna"],
    "spk": ["spolka komandytowa"],
    "spp": ["spolka partnerska"],
    "spzoo": ["sp z o o", "sp z oo", "spolka z ograniczona odpowiedzialnoscia"],
    "ug": ["ug haftungsbeschrankt", "unternehmergesellschaft haftungsbeschrankt"],
    "zrt": ["zartkoruen mukodo reszvenytarsasag"],
}

# Words of descriptions and what they become; the empty one drops a word.
DESCRIPTORS = {
    "": ["and"],
    "assoc": ["associate", "associates"],
    "dept": ["department"],
    "dev": ["development"],
    "ent": ["enterprise", "enterprises"],
    "exp": ["export", "exports"],
    "grp": ["group"],
    "hldg": ["holding", "holdings"],
    "imp": ["import", "imports"],
    "ind": ["industries", "industry"],
    "info": ["information"],
    "intl": ["int", "international"],
    "mfg": ["manuf", "manufac", "manufact", "manufacturing", "mfr", "mftg"],
    "mgmt": ["management", "mgt"],
    "sln": ["solutions"],
    "svc": ["ser", "serv", "service", "services", "srv", "srvc", "svcs"],
    "tech": ["technologies", "technology", "techs"],
    "trd": ["trade", "trading"],
}
COMPOUND_DESCRIPTORS = {"impexp": ["import export", "imp exp"]}

# Latin letters that no decomposition opens.
ATOMIC_LETTERS = {"Ł": "l", "ł": "l", "Ø": "o", "ø": "o", "Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "ß": "ss", "Þ": "th", "þ": "th", "Ð": "d", "ð": "d", "Đ": "d", "đ": "d", "ı": "i", "İ": "i"}
DROPPED_CHARACTERS = ".'-_+"


def phrases(table: dict[str, list[str]]) -> dict[str, str]:
    """phrase -> target, longest phrases first."""
    pairs = [(p, t) for t, ps in table.items() for p in ps]
    return dict(sorted(pairs, key=lambda x: (-len(x[0].split()), -len(x[0]), x[0])))
