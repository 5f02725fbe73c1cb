"""The pattern families of the style scan and of the sentence cues, and the lists of the origin policy."""

from __future__ import annotations

from typing import NamedTuple


class Family(NamedTuple):
    id: str
    category: str
    rx: str


# Style families.
STYLE = (
    Family("inflated_significance", "content", r"(?:长期|一直)(?:以来)?被.{0,16}忽视|无法回避的事实|从根源上|(?:历史)?真实性|至关重要|关键(?:性)?作用|深远影响|标志着.{0,12}(?:转变|时刻)"),
    Family("vague_attribution", "content", r"史学界|史料记载|查阅了?(?:大量|相关|多方|现有)(?:的)?(?:资料|文献|信息)|资料显示|研究表明|专家(?:普遍)?认为|业内人士(?:指出|认为)|多项研究"),
    Family("formulaic_transition", "structure", r"起初.{0,36}(?:但|然而)|进一步(?:审视|分析|探讨|研究)|(?:我|我们)?带着(?:这些|上述|这一)?(?:疑问|问题)|(?:原来|结果发现)[，,:：]"),
    Family("overexplained_reveal", "reader_trust", r"天[！!].{0,30}原来|(?:时间|逻辑|背景|条件|技术)(?:上|层面)?(?:的)?(?:错位|差异|限制).{0,36}(?:阻断|导致|意味着|不可能)|即便.{0,36}也会.{0,30}(?:真实性|完整性|可信度)"),
    Family("ai_lexicon_cluster", "language", r"进一步|审视|详尽(?:的)?描述|从根源上|长期(?:被)?|无法回避|强行植入|生活形态|相互作用|格局|深入探讨|彰显"),
    Family("negative_parallelism", "language", r"没有.{0,36}(?:更没有|也没有)|不仅(?:仅)?.{0,40}(?:而且|而是)"),
    Family("generic_closure", "structure", r"即便.{0,45}(?:也会|仍会)|由此可见|综上所述|从而.{0,24}(?:确保|推动|促进|彰显)"),
    Family("chatbot_trace", "communication", r"希望这对您有帮助|如果您想让我|请告诉我|当然[！!]|您说得完全正确|根据我最后的训练|基于可用信息"),
    Family("promotional_language", "content", r"令人叹为观止|充满活力|开创性|改变一切|无缝.{0,8}体验|不断演变的.{0,8}格局|必游之地|卓越之旅"),
    Family("overqualification", "language", r"可能.{0,8}(?:潜在地|也许|或许).{0,12}可能|可以潜在地可能"),
    Family("formulaic_enumeration", "structure", r"首先|其次|此外|与此同时|值得注意的是|更重要的是|综上所述|由此可见"),
    Family("balanced_template", "language", r"不仅.{0,50}(?:而且|更|还)|一方面.{0,80}另一方面|既要.{0,50}也要"),
    Family("generic_conditional_closure", "structure", r"只有.{0,80}才能|最终实现.{0,30}(?:长期)?(?:价值|目标|增长)"),
)


class Structural(NamedTuple):
    id: str
    category: str
    #: Matches of all of these count together.
    rxs: tuple[str, ...]
    least: int


# Structural families, which count from a least number of matches.
STRUCTURAL = (
    Structural("rhetorical_question_chain", "structure", (r"(?:为什么|为何)[^？?]{0,90}[？?]",), 3),
    Structural("mechanical_parallelism", "structure", (r"(?m)(?:^|[。！？?])[ ]*为什么", r"(?m)(?:^|[。；])[ ]*他写"), 3),
    Structural("enumeration_stacking", "structure", (r'[“"][^”"]*(?:、[^”"]*){2,}[”"]|(?:[“"][^”"]{1,20}[”"][、，,]?){3,}',), 2),
    Structural("positive_affect_saturation", "sentiment", (r"喜欢|爱(?:你|大家|这个|上)?|感谢|感激|温暖|甜蜜|幸福|开心|惊喜|太棒|美好|治愈|可爱",), 3),
    Structural("assertive_language_cluster", "pragmatics", (r"显然|毫无疑问|绝对|肯定|一定|必然|不可否认|毋庸置疑|事实证明",), 3),
)

# Context of the style scan.
DATES = r"(?U)\b(?:19|20)\d{2}\b|公元\s*\d{3,4}\s*年"
VOICE = r"我|真的|天[！!]|哈哈|居然|没想到"
PLATFORM_MARKERS = r"(?U)@\w+|#[^\s#]+|https?://|[\x{1F300}-\x{1FAFF}]"
GAME = r"游戏|英雄|技能|上线|皮肤|双排|王者"
HISTORY = r"历史|史料|公元|元朝|游记"


class Cue(NamedTuple):
    id: str
    weight: int
    rx: str


# Sentence cues.
CUES = (
    Cue("formulaic_investigation", 2, r"起初|进一步(?:审视|分析|研究)|(?:我|我们)?带着(?:这些|上述|这一)?(?:疑问|问题)|查阅了?(?:大量|相关|多方|现有)(?:的)?(?:资料|文献|信息)|原来[，,:：]"),
    Cue("inflated_problem_frame", 2, r"(?:长期|一直)(?:以来)?被.{0,18}忽视|无法回避的事实|从根源上|(?:真实性|完整性|可信度|长期价值)"),
    Cue("rhetorical_question", 2, r"(?:为什么|为何).{0,100}[？?]"),
    Cue("vague_authority", 2, r"史学界|史料记载|研究表明|专家认为|大量(?:的)?资料"),
    Cue("overexplained_reveal", 2, r"天[！!].{0,40}原来|(?:时间|逻辑|背景|条件|技术)(?:上|层面)?(?:的)?(?:错位|差异|限制).{0,50}(?:阻断|导致|意味着|不可能)|即便.{0,50}也会"),
    Cue("formal_abstract_cluster", 1, r"进一步|详尽|审视|概念|生活形态|完全脱节|强行植入|从根源上|持续赋能|长期价值|竞争格局|核心优势"),
    Cue("formulaic_disclosure", 2, r"首先|其次|此外|与此同时|值得注意的是|更重要的是|综上所述|由此可见"),
    Cue("balanced_template", 2, r"不仅.{0,50}(?:而且|更|还)|一方面.{0,80}另一方面|既要.{0,50}也要"),
    Cue("generic_conclusion", 2, r"这(?:充分)?说明|这意味着|只有.{0,80}才能|最终实现.{0,30}(?:价值|目标|增长)"),
)
QUOTED = r'[“"][^”"]+[”"]'

# Origin policy.
PLATFORM_LABELS = (
    "ai-generated", "ai generated", "generated with ai", "made with ai", "created using generative ai",
    "edited using generative ai", "ai 生成", "ai生成", "由 ai 生成", "由ai生成",
)
NEGATIONS = (
    r"\b(?:i|we)\s+(?:deny|denied|dispute|reject)\s+that\b.{0,120}\bai\b",
    r"\bit\s+is\s+(?:false|untrue|incorrect)\s+that\b.{0,120}\bai\b",
    r"\b(?:not|isn['’]t|wasn['’]t|never)\b.{0,45}\b(?:ai[- ]generated|generated (?:with|by) ai)\b",
    r"\b(?:claim|discussion|debate|question|rumou?r|allegation)\b.{0,45}\bai[- ]generated\b",
    r"\bai[- ]generated\b.{0,45}\b(?:false|incorrect|misleading|untrue|claim)\b",
    r"(?:不是|并非|非|没有|未曾|从未).{0,18}(?:ai|人工智能).{0,8}(?:生成|创作|辅助)",
    r"(?:讨论|声称|质疑|传言|所谓).{0,20}(?:ai|人工智能).{0,8}(?:生成|创作|辅助)",
    r"(?:ai|人工智能).{0,8}(?:生成|创作|辅助).{0,18}(?:说法|指控|传言).{0,8}(?:不实|错误|虚假)",
    r"\b(?:said|wrote|reads|quote|quoted|quoting|alleged)\b.{0,100}\b(?:i|we)\s+(?:made|created|generated|edited|wrote)\b.{0,80}\bai\b",
    r"(?:引述|引用|原文|写着|他说|她说|对方说).{0,100}(?:我|我们).{0,30}(?:ai|人工智能).{0,12}(?:生成|创作|撰写|改写|编辑)",
    r"(?:fabricated|forged|fake|false).{0,50}(?:quote|sentence|caption|statement)|(?:quote|sentence|caption|statement).{0,50}(?:fabricated|forged|fake|false)",
    r"(?:伪造|捏造|虚构|不实).{0,30}(?:引文|引述|句子|说明)|(?:引文|引述|句子|说明).{0,30}(?:伪造|捏造|虚构|不实)",
    r"(?:我|我们|作者|本人).{0,8}(?:否认|驳斥|澄清并非|澄清不是).{0,100}(?:ai|人工智能).{0,16}(?:生成|创作|撰写|改写|编辑)",
)
DISCLOSURES = (
    r"\b(?:i|we)\s+(?:made|created|generated|edited|wrote|rewrote)\s+(?:(?:this|the)\s+(?:post|image|text|content)|this)\s+(?:with|using|by)\s+(?:generative\s+)?ai\b",
    r"\b(?:(?:this|the)\s+(?:post|image|text|content)|this)\s+(?:was|is)\s+(?:made|created|generated|edited|written|rewritten)\s+(?:with|using|by)\s+(?:generative\s+)?ai\b",
    r"(?:我|我们)\s*(?:使用|用了|借助|通过)\s*(?:生成式)?(?:ai|人工智能)\s*(?:生成|创作|撰写|改写|编辑)(?:了)?\s*(?:这|本|该)?(?:篇|张|段|条)?(?:帖子|图片|文本|内容|文章)",
    r"(?:这|本|该)(?:篇|张|段|条)?(?:帖子|图片|文本|内容|文章)\s*(?:由|是我用|是我们用)\s*(?:生成式)?(?:ai|人工智能)\s*(?:生成|创作|撰写|改写|编辑)",
)
QUOTED_SPAN = r"[\"“‘]([^\"”’]{1,300})[\"”’]"
MENTIONS_AI = r"(?:^|[^a-z])ai(?:[^a-z]|$)|人工智能"
MAKING = r"generated|created|made|edited|written|rewritten|生成|创作|撰写|改写|编辑"
