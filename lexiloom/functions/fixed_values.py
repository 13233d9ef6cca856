"""Patterns, word lists and thresholds that results depend on.

Everything here is a constant of the data format or of the published rule set, written
out as text. Operators take these as default arguments, so other corpora pass their own.
"""

# --- Fixed values: special token ids (surface ids, 1-based) ---------------------------
PAD_ID = 1
UNK_ID = 2
BOS_ID = 3
EOS_ID = 4
VOCAB_SIZE = 2**14
BLOCK_LEN = 512
SOFT_TOP_K = 16
JUNK_STUDENT_IDS = (1, 2, 3, 4, 4346)

# --- Fixed values: quality gate -------------------------------------------------------
GATE_MIN_CHARS = 30
GATE_MIN_PURITY = 0.5
GATE_INIT_REASON = "Init_TooShort_or_LowHan"
GATE_POST_REASON = "PostClean_TooShort_or_LowHan"
HAN = r"\p{IsHan}"
LETTERS = r"[a-zA-Z]"

# --- Fixed values: markup and quotes --------------------------------------------------
HTML_TAG = r"<[^>]*>"
HTML_ENTITY = r"&[a-zA-Z0-9#]+;"
CORNER_QUOTES = "「」"

# --- Fixed values: wrapper cuts, applied in this order --------------------------------
WRAPPER_PATTERNS = (
    r"^.*?写一篇.*?(的文章|内容)[。|：|\.]?\s*(好的，)?以下是(为您|为您准备的|您请求的|我写的)?文章[：|。|\s]*",
    r"^(好的，)?我会为您写一篇.*?[：|。|\s]*",
    r"请(从上述文章中|把文章中的|从文章中)?提取.*$",
    r"提取(出)?这篇文章的关键词.*$",
    r"(给出|给定|给我|查找|设计|创建|编写|提供|生成|评价|介绍|提示|写)一(篇|种|份|个|款).*$",
)

# --- Fixed values: layout residue, applied in this order -------------------------------
LEADING_MARKS = r"^[：:\?？\|\s·•▪▲——\-）\)\]\}、,，\.。\;；①②③④⑤⑥⑦⑧⑨⑩]+"
FOOTNOTE_MARKS = r"\(\s*\d+\s*\)|\[\s*\d+\s*\]"
ITEM_NUMBERS = r"(?m)^\s*\d+[\]\)\}\.、]\s*"
SECTION_PREFIX = r"(?m)^\d+(\.\d+)*\s*\n?.*\n?"
DEAD_PLACEHOLDERS = (
    r"请访问\s*。",
    r"（\s*，|\(\s*for\s+big\s+data",
    r"（\s*and\s+ethics\s*）|\(\s*and\s+ethics\s*\)",
)
BULLETS = r"[•▪▲\t]"
BOLD = r"\*\*(.*?)\*\*"
ISOLATED_DOT = r"\s+\.\s+"
LEADING_DOT = r"^\s*\.\s*"
ESCAPED_QUOTE = r'\\?"'
RULE_LINE = r"(?m)^\s*[-*]{3,}\s*$"
REASONING_BLOCK = r"(?s)<think>.*?(?:</think>|<\\/think>)(?:\\n|\n)*"

# --- Fixed values: residue funnel, first hit wins ---------------------------------------
FUNNEL_MIN_CHARS = 100
PUNCT_DENSITY_LIMIT = 0.15
FUNNEL_RULES = (
    ("traditional_script", r"[隨變發趨數據體轉廣響應業範劃變陣體欄優導進製]"),
    ("service_chat", r"帮我查一下天气|查询哪个城市|北京的天气|最高温度为|最低温度为|注意防晒|携机票|单程还是往返|现在几点了"),
    ("front_matter", r"推荐序|副行长|车品觉先生|前言建立|目录推荐序|练习 IV|作业 \d"),
    ("question_lead", r"^(如何|怎样|该如何|该怎样|我应该如何|哪些|什么是).*(更有效|改善|避免|坚持|合理安排|利用|有效利用|提升|打破|阻止|积极参与|社会领域|克服)"),
    ("stock_answer", r"以下是一些方法|考虑任务优先级的几个因素|以下是考虑任务优先级|方法来更好地集中注意力|以下是一些方法可以寻求帮助|机器学习是人工智能的一个重要分支|防止网络安全攻击的最佳方法|快速响应和解决问题的步骤|在上述领域中|总的来说，人工智能可以|这些方法听起来都很实用"),
    ("request_lead", r"^(该如何|我应该|我要|我该|我想|如何|怎样|该怎样|我该?如何|我想了解).*(开发|避免|实施|提高|准备|提升|解决|利用|结合|做到|注意)"),
    ("step_phrases", r"可以按照以下步骤|以下是一些建议|以下是一般的步骤|以下是一些处理|综上所述"),
    ("topic_phrases", r"在开发解决方案时|如何确定最佳的编程语言|处理演讲中的紧张情绪"),
    ("prompt_leak", r"写篇|写一|你好|内容： |写篇关于|题目：|基于以下角色|给你两个角色信息|作为一名AI|MOSS|实体识别|实体抽取|列出|列举"),
)

# --- Fixed values: multi-rule line filter ------------------------------------------------
MULTI_RULES = (
    ("middot_name", r"[\x{4e00}-\x{9fa5}]+[\x{00b7}\x{2022}\x{2027}][\x{4e00}-\x{9fa5}]+"),
    ("ebook", r"(?i)ebook"),
    ("traditional_script", r"[護漸這們會說過對還個為與從時進學實發動網機體點廠廣車頁見長門風飛馬鳥麥東魚愛]"),
    ("phrase", r"__|以下文本|文案|原始文本|请回答问题|中文回答|根据给出|给定的文章|提取下|请根据|请编辑|改写|创作一首|进行摘要|将以下|总结并|你认为|学习贯彻|提问|一段文字|提取以下|请告诉我|祝您|当前位置|以下段落|将下面|是的|帮我|提取关键|总结一下|总结以下|根据给定|一段文本|摘要生成|以下问题|下面的文本|从一段|文本纠错|给定一|我是一个|根据给定的|生成一个|为以下|根据以下|意识形态|人工智能在医疗|更好地理解|例如，可以使用|人工智能可以通过|他们的对话|以下是|网址|来源|script|两个维护|全市|总书记|同志|市委|例子|防控|可以根据学生的学习"),
)

# --- Fixed values: web corpus rules --------------------------------------------------------
WEB_MIN_CHARS = 300
WEB_MAX_CHARS = 3000
WEB_BLOCKLIST = r"工作|建议|成立|课|意见|公告日期|首页|您的位置|我想做代理|请寄给我详细资料|加微信|人民法院|javascript"
URL = r"(?i)(https?://[^\s]+|www\.[^\s]+|[a-zA-Z0-9][-a-zA-Z0-9]{0,62}(\.[a-zA-Z0-9][-a-zA-Z0-9]{0,62})+\b)"
HAN_RANGE = r"[\x{4e00}-\x{9fa5}]"
WEB_MIN_RATIO = 0.85
TIMESTAMP = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}"
NEWS_TAIL = r"(?s)(返回搜狐.*|声明：本文由入驻搜狐号.*)"
STAR_BREAK = r"\s+\*\s+"
SOURCE_TITLE = "原标题："

# --- Fixed values: instruction pairs ---------------------------------------------------------
HAN_OR_FULLWIDTH = r"[\x{4e00}-\x{9fa5}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
CHAT_INSTRUCTION_BLOCK = ("[A-Za-z]", "Joy|AI|MOSS|故事|场景|moss|聊天|app|画|图")
CHAT_OUTPUT_BLOCK = ("MOSS|故事|场景|moss|聊天|app|画|图|1",)
CHAT_LATE_INSTRUCTION_BLOCK = ("回答|电影|狗|机器人|影片|智慧|这个|人工|情节|故事|场景|歌|聊天|小说|画|图|诗",)
CHAT_LATE_OUTPUT_BLOCK = ("指的|从上文|作为|请问|抱歉|请提供|请告诉",)
CHAT_PAIR_BAND = (75, 350, 0.8)
TRIPLE_INSTRUCTION_BLOCK = ("[A-Za-z]", "抱歉|故事|场景|moss|聊天|app|画|图")
TRIPLE_OUTPUT_BLOCK = ("您说|抱歉|故事|场景|无法|聊天|是的|好主意|图",)
TRIPLE_PAIR_BAND = (45, 500, 0.99)
TRAILING_PUNCT = r"[\?？。\.!！,，;；\s\p{P}]+\z"
CLOSING_PUNCT = r"[。？！”’)）\]]\z"
PAIR_MIN_OUTPUT = 30
THINK_LEFTOVER = r"(?i)think"
ENDING_QUESTION_SHARE = 0.33
ENDING_STOP_SHARE = 0.66

# --- Fixed values: entity density --------------------------------------------------------------
ENTITY_MIN_WORDS = 5
ENTITY_MAX_DISTINCT = 8
ENTITY_MAX_DENSITY = 0.10

# --- Fixed values: tokenizer text preparation ----------------------------------------------------
ISOLATED_PUNCT = r"""([,.:;!?"'()\{\}\[\]，。！？；：—（）《》“”‘’、])"""
SPECIAL_TAGS = r"<BOS>|<EOS>|<PAD>|<UNK>"
CJK_GAP = (
    r"(?<=[\x{4e00}-\x{9fa5}\x{3000}-\x{303f}\x{ff00}-\x{ffef}])\s+"
    r"(?=[\x{4e00}-\x{9fa5}\x{3000}-\x{303f}\x{ff00}-\x{ffef}])"
)
GAP_BEFORE_PUNCT = r"(?<=[a-zA-Z0-9])\s+(?=[,.?!:;/()])"
GAP_AFTER_OPENER = r"(?<=[(.])\s+(?=[a-zA-Z0-9])"
LEAD_PUNCT = r"^[\s\p{Punct}。？！，、：；]+"

# --- Fixed values: link graph ----------------------------------------------------------------------
WIKI_PREFIX = "/wiki/"
LINK_NAMESPACES = (
    r"wiki/(File|Category|Template|Wikipedia|Help|Portal|Special|Talk|User|MediaWiki|Draft"
    r"|TimedText|Module|Gadget|Gadget_definition|Topic):"
)
TOPIC_BLOCK = "Glossary|List|ournal|onference"

# --- Fixed values: concept keep mask -----------------------------------------------------------------
CONCEPT_WHITELIST = r"(?i)\((machine learning|computer science|mathematics|physics|biology|psychology|statistics|economics|sociology|chemistry|algorithm|model|discipline|neural network)\b"
CONCEPT_INVALID = r"(?i)^(List of|Outline of|Category:|Index of|Glossary of)"
CONCEPT_ENTITY = r"(?i)\((mathematician|physicist|chemist|biologist|philosopher|politician|historian|born|died|novel|film|album|song|city|state|country|war|[0-9]{4})\b"
CONCEPT_KEYWORDS = r"(?i)(ology|ics|graphy|metry|science|studies|theory|analysis|engineering|mechanics|dynamics|chemistry|physics|biology|math|philosophy|economics|sociology|law|pricing|capture|commercialization|management|policy|system|method|protocol|algorithm|network|model|effect|architecture|framework|learning|structure|process|concept)"
CONCEPT_CUTOFF = 0.06

# --- Fixed values: association mining -------------------------------------------------------------------
PMI_MIN_COUNT = 15
PMI_MAX_COUNT = 300
PMI_MIN = 8.5
PMI_MAX = 13.5
PMI_TOP = 500
ENTITY_SHAPE = r"^\p{IsHan}+\z"
ENTITY_LENGTH = (3, 6)
ENTITY_PUNCT = r"[，。、？！；：“”‘’《》【】（）]"
ENTITY_BAD_PREFIX = r"^(一|在|从|以|和|与|及)"
ENTITY_BAD_SUFFIX = r"(的|了|地|等)\z"

# --- Fixed values: evaluation ---------------------------------------------------------------------------
SEMANTIC_THRESHOLD = 0.73
REJECT_BELOW = -4.0
ENTROPY_BANDS = (0.5, 1.2)
WATERMARK_KEY = 421337
WATERMARK_GAMMA = 0.5
WATERMARK_Z = 2.0
CATEGORY_NAMES = {
    "adversarial": "对抗鲁棒性",
    "instruction": "指令遵循",
    "knowledge": "知识记忆",
    "language": "语言理解",
    "machine_learning": "机器学习",
    "math": "数学推理",
    "memory": "记忆召回",
    "pattern": "模式识别",
    "reasoning": "逻辑推理",
}
SUBCATEGORY_NAMES = {
    "distractor": "干扰项识别",
    "instruction_attack": "指令攻击",
    "format_following": "格式遵循",
    "selection": "选择筛选",
    "general_knowledge": "常识知识",
    "ambiguity": "歧义消解",
    "coreference": "指代消解",
    "entailment": "蕴含判断",
    "reading": "阅读理解",
    "semantic_relation": "语义关系",
    "machine_learning": "机器学习知识",
    "arithmetic": "算术运算",
    "multi_step": "多步推理",
    "novel_rule": "新颖规则",
    "sequence": "序列预测",
    "word_problem": "应用题",
    "fact_recall": "事实回忆",
    "relational_recall": "关系回忆",
    "reverse_recall": "反向回忆",
    "analogy": "类比推理",
    "number_pattern": "数字规律",
    "symbol_pattern": "符号规律",
    "conditional": "条件逻辑",
    "constraints": "约束满足",
    "ordering": "排序顺序",
    "syllogism": "三段论",
}
OVERALL_NAME = "★ 总体平均"
QUOTA_PLAN = (
    ("language_understanding", "lang", 200),
    ("math_reasoning", "math", 200),
    ("logic_reasoning", "logic", 200),
    ("pattern_induction", "pat", 150),
    ("working_memory", "mem", 150),
    ("common_sense", "cs", 400),
    ("instruction_following", "inst", 100),
    ("adversarial_robustness", "adv", 100),
)
QUOTA_BATCH = 50
PROMPT_BATCH = 20
