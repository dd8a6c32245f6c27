"""Dictionaries of variants: fixed values."""

from __future__ import annotations

# Canonical words and their variants.
VARIANTS: dict[str, list[str]] = {
    "牛逼": ["牛批", "牛B", "牛比", "牛碧", "牛杯", "流批", "niubi", "NB", "nb"],
    "傻逼": ["煞笔", "沙比", "纱碧", "沙雕", "傻比", "烧饼", "shabi", "sb", "SB", "啥呗", "iceb", "艾斯比"],
    "卧槽": ["卧日", "我操", "我草", "窝草", "我艹", "握草", "wocao", "WC", "wc"],
    "加油": ["加游", "加由", "加铀", "jiayou"],
    "永远的神": ["永远滴神", "yyds", "YYDS"],
    "主播": ["灰泽", "灰泽哥", "小满", "满满", "小灰", "满神", "满区", "灰泽满酱", "灰泽满", "hzm", "满姐"],
    "哈哈哈": ["hhhh", "蛤蛤蛤", "红红火火恍恍惚惚"],
    "谢谢": ["蟹蟹", "感谢"],
    "来了": ["来了来了", "来来来"],
    "离谱": ["离大谱", "太离谱了"],
    "逆天": ["太逆天了"],
    "无敌": ["无敌了", "wudi"],
    "破防": ["破防了", "真破防"],
    "拿下": ["拿下了"],
    "起飞": ["芜湖起飞", "起飞了"],
    "太强了": ["这也太强了", "太强了呀"],
    "害怕": ["害怕了", "太可怕了"],
    "不是": ["？？不是", "不是吧"],
    "哭了": ["看哭了", "泪目", "破防了"],
    "下饭": ["太下饭了", "下饭了"],
    "要死": ["🔑"],
    "难听": ["南亭"],
    "好听": ["好亭", "豪听"],
    "周杰伦": ["巴哥"],
    "弱智": ["弱子，若只"],
    "智力": ["智利"],
}

# Whole texts that the browser profile replaces.
WHOLE_TEXT: dict[str, str] = {
    "xswl": "笑死我了",
    "yyds": "永远的神",
    "awsl": "啊我死了",
    "u1s1": "有一说一",
    "srds": "虽然但是",
    "zqsg": "真情实感",
    "dbq": "对不起",
    "nsdd": "你说得对",
    "pljj": "漂亮姐姐",
    "nmd": "你妈的",
    "wsnd": "我是你的",
    "tql": "太强了",
    "sdl": "速度了",
}

# Characters that tell praise from blame.
PRAISE = ("好", "棒", "牛", "强", "厉害", "无敌", "神", "帅", "绝", "赞")
BLAME = ("烂", "差", "菜", "弱", "垃圾", "恶心", "难听", "丑", "蠢", "废")

#: A small dictionary for texts in Latin letters, as in the sample tables.
LATIN: dict[str, str] = {"les.": "les", "la": "le", "los": "el", "die": "der", "das": "der", "oned": "one", "is": "be", "was": "be", "are": "be"}


def entries() -> list[tuple[str, str]]:
    """(variant, canonical) in order of listing."""
    return [(v, c) for c, listed in VARIANTS.items() for v in listed]
