"""A small rule pack of our own phrases, as (lang, role, phrase) rows; users bring their own table of the same shape."""

from __future__ import annotations

#: Roles of phrases. An implicit phrase is a whole proposition that aims at its reader without naming a target.
ROLES = (
    "target", "harm", "intent", "implicit_threat", "wish", "outcome", "implicit_wish", "self_harm", "insult", "implicit_insult",
    "sentiment", "copula", "negator", "report", "counterspeech", "boundary", "benign",
)
#: Languages written without gaps between words: phrases are runs of characters.
COMPACT = ("ZH", "JA", "KO")

_PACK = """
EN target: you, u, him, her, them, those people
EN harm: hit, punch, smash, beat up
EN intent: will, gonna, i will, going to
EN implicit_threat: watch your back, sleep lightly tonight
EN wish: i hope, i wish
EN outcome: fall, lose everything, get hurt
EN implicit_wish: rot alone
EN self_harm: go hurt yourself
EN insult: fool, muppet, clown, complete idiot
EN implicit_insult: total clown
EN sentiment: awful, sick of
EN copula: are, is, such
EN negator: not, never, no, nobody
EN report: he said, she wrote, they claim
EN counterspeech: do not say, stop saying
EN boundary: but, although
DE target: du, dich, ihr, euch
DE harm: schlagen, verprügeln, schlage
DE intent: werde, ich werde
DE wish: ich hoffe, hoffentlich
DE outcome: fällst, verlierst alles
DE insult: dummkopf, trottel
DE sentiment: furchtbar
DE copula: bist, seid
DE negator: nicht, kein, keine, nie
DE report: er sagte
DE counterspeech: sag nicht
DE boundary: aber
ES target: te, tú, usted, ustedes
ES harm: golpear, pegar
ES intent: voy a, vamos a
ES wish: ojalá
ES outcome: caigas, pierdas todo
ES insult: tonto, payaso
ES copula: eres, es
ES negator: no, nunca
ES report: dijo que
ES counterspeech: no digas
ES boundary: pero
ES benign: pegar el papel
ZH target: 你, 你们
ZH harm: 打, 揍
ZH intent: 我要, 我会
ZH implicit_threat: 你等着瞧
ZH wish: 希望
ZH outcome: 倒霉, 摔倒
ZH self_harm: 去伤害自己
ZH insult: 笨蛋, 小丑
ZH sentiment: 讨厌
ZH copula: 是, 真是
ZH negator: 不, 没有
ZH report: 他说
ZH counterspeech: 别说
ZH boundary: 但是
JA target: お前, あなた
JA harm: 殴る
JA intent: 必ず
JA insult: ばか
JA copula: は
JA negator: ない
JA report: と言った
KO target: 너, 너는
KO insult: 바보
KO copula: 는
KO negator: 아니다
KO report: 라고 말했다
"""


def default_pack() -> list[tuple[str, str, str]]:
    """(lang, role, phrase) rows."""
    out = []
    for line in _PACK.strip().splitlines():
        head, _, phrases = line.partition(": ")
        lang, role = head.split()
        out += [(lang, role, phrase) for phrase in phrases.split(", ")]
    return out


#: Messages in pairs, one that a rule must judge and controls that it must not: (id, lang, text, what is found).
MESSAGES = [
    (-1, "EN", "I will hit you.", "threat"), (-2, "EN", "I will not hit you.", "threat negated"), (-3, "EN", "Hit them?", None),
    (-4, "EN", "Punch him now", "threat"), (-5, "EN", "Punch him now?", None), (-6, "EN", 'The film has "I will hit you" in it', "threat quoted"),
    (-7, "EN", "I hope you fall", "wish"), (-8, "EN", "he said I hope you fall", "wish reported"), (-9, "EN", "I hope the prices fall", None),
    (-10, "EN", "You are a fool", "insult"), (-11, "EN", "You are no fool", "insult negated"), (-12, "EN", "stop saying you fool", "insult counterspeech"),
    (-13, "EN", "Only a fool would ask", None), (-14, "EN", "Go hurt yourself", "self_harm"), (-15, "EN", "never go hurt yourself", "self_harm negated"),
    (-16, "EN", "Watch your back!", "implicit_threat"), (-17, "EN", "Watch your back door", None), (-18, "EN", "Total clown", "implicit_insult"),
    (-19, "EN", "Rot alone in peace", None), (-20, "EN", "well but rot alone", "implicit_wish"), (-21, "EN", "you awful thing", "sentiment"),
    (-22, "EN", "what awful weather", None), (-23, "EN", "you are not kind, you are a fool", "insult"), (-24, "EN", "You clown, I will smash them", "threat insult"),
    (-25, "DE", "Ich werde dich schlagen", "threat"), (-26, "DE", "Ich werde euch nie schlagen", "threat negated"), (-27, "DE", "Du bist ein Trottel", "insult"),
    (-28, "ES", "Eres tú payaso", "insult"), (-29, "ES", "Voy a pegar a usted", "threat"), (-30, "ES", "Voy a pegar el papel", None),
    (-41, "ZH", "我要打你！", "threat"), (-42, "ZH", "我会不打你", "threat negated"), (-43, "ZH", "你是笨蛋。", "insult"), (-44, "ZH", "你不是笨蛋。", "insult negated"),
    (-45, "ZH", "他说你是笨蛋", "insult reported"), (-46, "ZH", "「你是笨蛋」太老套", "insult quoted"), (-47, "ZH", "你等着瞧!", "implicit_threat"), (-48, "ZH", "希望你倒霉", "wish"),
    (-49, "ZH", "希望你倒霉的日子过去", None), (-50, "ZH", "去伤害自己", "self_harm"), (-51, "ZH", "去伤害自己的人", None), (-52, "JA", "お前は ばか", "insult"),
    (-53, "JA", "お前は、ばか と言った", "insult reported"), (-54, "KO", "너는 바보", "insult"), (-55, "KO", "너는 바보 라고 말했다", "insult reported"),
]
