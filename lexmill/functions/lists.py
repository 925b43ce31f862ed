"""Word lists and weight tables."""

from __future__ import annotations

STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his if in into is it its not no of on or she so than that the their them then there these they this to was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist ja kein mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur",
    "fr": "au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais me ne nous on ou par pas plus pour qu que qui sa se ses si son sont sur un une vous",
    "es": "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también un una y",
    "zh": "的 了 和 是 在 也 就 都 与 及 或 而 被 把 对 从 为 以 于 这 那 有 不 没有 没 无 非 未 我 你 他 她 它",
}
NEGATIVE = {"en": "no not nor never without", "de": "nicht kein nie ohne nein", "fr": "ne pas non sans jamais", "es": "no ni sin nunca", "zh": "不 没有 没 无 非 未"}
ALL_STOP_WORDS = sorted({w for v in STOP_WORDS.values() for w in v.split()})
ALL_NEGATIVE = sorted({w for v in NEGATIVE.values() for w in v.split()})

TIME = "(?:[0-9]+|[一二三四五六七八九十两上下本今昨明前后去]+)(?:年|月|日|号|时|点|分|秒|周|天|周末|星期|礼拜)(?:[一二三四五六日天末])?|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|(?:mon|tues|wednes|thurs|fri|satur|sun)day|today|tomorrow|yesterday|january|february|march|april|june|july|august|september|october|november|december"
NUMBER = "[0-9０-９]+(?:[.,][0-9]+)*%?|[一二三四五六七八九十百千万亿零两]+"
PLACE = ".+(?:省|市|县|区|镇|乡|村|自治州|自治区)"

#: Part-of-speech classes of the phrase rules.
FUNCTION_TAGS = ("u", "p", "c", "y", "e", "o", "w")
STRICT_TAGS = ("a", "n", "nr", "ns", "nt", "nx", "nz", "ad", "an", "vn", "vd", "vx")
TAG_NAMES = {"nr1": "nr", "nrf": "nr", "vi": "v", "wx": "w", "x": "nz"}
#: Weight of a phrase by its number of tokens, and of any other number.
LENGTH_WEIGHTS = {1: 1.0, 2: 5.6, 3: 1.1, 4: 2.0, 5: 0.7, 6: 0.9, 7: 0.48, 8: 0.43, 9: 0.24, 10: 0.15, 11: 0.07, 12: 0.05}
OTHER_LENGTH = 0.01
#: Weight of a phrase by its tag, or by its first and last tag; 1.0 for any other.
TAG_WEIGHTS = {
    "n": 0.9154, "q": 0.1174, "m": 0.5367, "r": 0.0, "n|n": 0.7507, "a": 0.6, "v|n": 0.6575, "f": 0.01887, "q|n": 0.01961, "vn": 0.8916, "b": 0.4, "n|t": 0.2143,
    "ns|n": 0.8253, "v|m": 0.1613, "ad": 0.6078, "t|n": 0.3286, "v|ns": 0.5, "v|t": 0.1429, "m|q": 0.4706, "v|q": 0.2609, "n|vn": 0.8462, "nt|t": 0.0, "n|ns": 0.4737,
    "n|a": 0.2308, "v|a": 0.3333, "v|b": 0.0, "l": 0.1, "n|m": 0.2, "vn|n": 0.8961, "nr|t": 0.125, "v|vn": 0.8571, "m|n": 0.78125, "t": 0.78, "n|b": 0.125,
    "v|nr": 0.5714, "v|s": 0.3333, "vd": 0.6154, "q|m": 0.0, "d|n": 0.6154, "v|nt": 0.0, "nt|b": 0.0, "v|r": 0.0, "nr|n": 0.6667, "ns|a": 0.2, "nr": 0.9487, "q|vn": 0.0,
    "d|b": 0.0, "ns|t": 0.2, "b|n": 0.8519, "q|ns": 0.0, "nr|vn": 0.5, "n|q": 0.5, "n|nr": 0.9211, "ns|b": 0.0, "ns|m": 0.0, "f|n": 0.625, "t|ns": 0.25, "n|nt": 0.0,
    "v|ad": 0.5714, "w|n": 0.0, "t|vn": 0.6, "s": 0.9636, "a|n": 0.9333, "ns|ns": 0.8462, "v|f": 0.0, "d|m": 0.0, "m|t": 0.0, "vn|nt": 0.0, "r|n": 0.8571, "t|a": 0.0,
    "t|m": 0.0, "n|l": 0.0, "a|m": 0.0, "m|m": 0.3333, "vn|t": 0.0, "q|b": 0.0, "n|s": 0.5, "nr|q": 0.0, "q|a": 0.0, "t|t": 0.6, "r|s": 0.0, "n|an": 0.0, "d|nz": 0.0,
    "s|t": 0.0, "f|t": 0.0, "v|an": 0.0, "a|a": 0.0, "vn|a": 0.0, "nt|vn": 0.0, "q|nr": 0.0, "r|m": 0.0, "n|f": 0.8333, "m|l": 0.0, "ns|s": 0.8889, "a|ad": 0.0,
    "b|vn": 0.75, "vn|nr": 0.6667, "vd|s": 0.0, "a|t": 0.0, "nt|nt": 0.0, "ad|nt": 0.0, "n|z": 0.0, "n|vx": 0.0, "n|r": 0.0, "ns": 0.9958, "nr|ns": 0.0, "vn|an": 0.0,
    "ns|vx": 0.0, "ns|nr": 0.9655, "b|q": 0.0, "nr|r": 0.0, "b|t": 0.0, "nt|ns": 0.8571, "ad|r": 0.0, "nt|n": 0.95, "nr|ad": 0.0, "nt": 1.0, "ns|vn": 1.0, "s|n": 1.0,
    "nz|n": 1.0, "an": 1.0, "ns|nt": 1.0, "nz": 1.0, "a|vn": 1.0, "ad|n": 1.0, "ns|f": 1.0, "d|ns": 1.0, "m|vn": 1.0, "t|f": 1.0,
}
