"""Word lists, thresholds, prices, rules and message texts.

These must stay as they are for results to agree with the documented behaviour.
"""

from __future__ import annotations

# --- fixed values: chunking and retrieval parameters -------------------------
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 100
SENTENCES_PER_CHILD = 3
SENTENCES_PER_PARENT = 15
AUTO_WINDOW_CHUNKS = 20
COARSE_K = 40
FINE_K = 5
SHORT_QUERY_BOOST = 10
SHORT_QUERY_CHARS = 15
STAGE1_THRESHOLD = 0.65
RERANK_MIN_SCORE = 0.0
RERANK_CANDIDATES = 20
CONFIDENCE_HIGH = 0.70
CONFIDENCE_MEDIUM = 0.50
CONFIDENCE_FALLBACK = 0.15
SUMMARY_TOP_K = 5
SUMMARY_MIN_DOCS = 10
RRF_K = 60
CHAT_ROUNDS = 30
CHAT_TOKENS = 8000
CHAT_PAGE = 20
SUMMARISE_TRIGGER = 20
SUMMARISE_KEEP = 20
EMBED_DIM = 1024
EMBED_BATCH = 32

# --- fixed values: file extensions by parser family --------------------------
PARSER_FAMILIES = {
    "pdf": [".pdf"],
    "ocr": [".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp"],
    "office": [".docx", ".pptx"],
    "text": [".txt"],
}

# --- fixed values: phrases of answers that admit not knowing ------------------
DONT_KNOW = [
    "我不知道", "没有找到", "无法找到", "无法回答", "没有相关信息", "知识库中没有", "抱歉，我无法",
    "抱歉，我没有", "对不起，我没有", "对不起，我无法", "暂未找到", "未能找到", "没有相关的信息",
    "无法提供", "不能回答", "不在我的知识范围内", "不在知识库中", "我无法提供", "我无法回答",
    "我没有找到", "我找不到",
]

# --- fixed values: phrases of refusals -----------------------------------------
REFUSAL = [
    "无法回答", "无法提供", "我不能回答", "我不能提供", "我不能", "抱歉", "对不起", "我无法回答",
    "我无法提供", "我不认为", "没有相关信息", "拒绝回答", "不便回答", "无法满足", "没有找到相关信息",
    "无法处理", "无法回应", "i cannot", "i can't", "i'm sorry", "i am sorry", "sorry",
    "cannot answer", "can't answer", "not able to", "cannot provide", "can't provide",
]

# --- fixed values: phrases that say the corpus holds no answer -------------------
NO_ANSWER = [
    "知识库中没有", "知识库中暂无", "知识库中未", "知识库暂未", "知识库尚无", "知识库不包含",
    "知识库未收录", "资料库中没有", "请先上传相关文档", "请上传相关文档",
]

# --- fixed values: greeting and summary phrases that are no claims ----------------
TEMPLATE_SENTENCES = ["你好", "您好", "感谢", "谢谢", "根据以上", "综上所述", "总的来说", "以下是"]

# --- fixed values: stop words of the term coverage ---------------------------------
STOP_WORDS = [
    "的", "了", "是", "在", "有", "和", "就", "不", "人", "都", "而", "及", "与", "着", "或", "一个",
    "没有", "我们", "你们", "他们", "什么", "怎么", "哪", "这", "那", "为", "吗", "呢",
]

# --- fixed values: claim and verdict thresholds ---------------------------------------
CLAIM_SUPPORTED = 0.75
CLAIM_PARTIAL = 0.50
HALLUCINATION_RATE = 0.30
PARTIAL_RATE = 0.50
PARENT_OVERLAP = 0.30
RETRIEVAL_FAIL = 0.1
RETRIEVAL_BORDERLINE = 0.5
RETRIEVAL_BASELINE = 0.3

# --- fixed values: safety categories (name, keywords, patterns) -------------------------
SAFETY_CATEGORIES = [
    ("harmful_content",
     ["暴力", "色情", "仇恨", "歧视", "自残", "自杀", "恐怖主义", "校园暴力", "虐待", "血腥"],
     []),
    ("prompt_injection",
     ["忽略指令", "忘记之前", "system prompt", "忽略以上", "无视规则", "突破限制", "模拟对话"],
     [r"(?i)(ignore|forget|disregard)\s+(all\s+)?(above|previous|instructions)",
      r"(?i)(不要|无需|不必)(遵循|遵守|理会)(.*?)(规则|指令|限制)"]),
    ("personal_info",
     ["身份证", "手机号", "银行卡", "密码", "住址", "社保号", "护照号", "信用卡"],
     [r"(?<!\d)\d{17}[\dXx](?!\d)",
      r"(?<!\d)1[3-9]\d{9}(?!\d)",
      r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"]),
    ("sensitive_topic",
     ["政治敏感", "宗教极端", "领土争端", "历史虚无主义", "分裂言论", "种族歧视", "邪教组织"],
     []),
    ("illegal_content",
     ["毒品", "赌博", "枪支", "爆炸物", "黑客", "钓鱼", "洗钱", "走私", "炸弹", "入侵", "作弊",
      "威胁", "恐吓"],
     []),
    ("misinformation",
     ["谣言", "阴谋论", "伪科学", "虚假新闻", "编造事实", "误导信息", "深度伪造"],
     []),
]

# --- fixed values: intervention rules (violation type, action, message, priority) ----------
INTERVENTION_RULES = [
    ("safety_harmful_content", "block", "检测到有害内容，已拦截回答", 1),
    ("safety_prompt_injection", "block", "检测到提示注入攻击，已拦截回答", 1),
    ("safety_personal_info_leak", "block", "检测到个人信息泄露风险，已拦截回答", 1),
    ("safety_sensitive_topic", "block", "检测到敏感话题，已拦截回答", 1),
    ("factuality_hallucination", "degrade", "检测到可能的幻觉，回答已降级处理", 2),
    ("factuality_contradiction", "degrade", "检测到事实矛盾，回答已降级处理", 2),
    ("factuality_source_mismatch", "degrade", "回答与来源内容不匹配，已降级处理", 2),
    ("retrieval_low_precision", "warn", "检索结果精确率偏低，请检查查询或索引", 3),
    ("retrieval_low_recall", "warn", "检索结果召回率偏低，建议补充知识库内容", 3),
    ("retrieval_no_results", "warn", "检索未返回有效结果", 3),
    ("relevance_low_score", "warn", "上下文与问题的相关性不足", 4),
    ("relevance_off_topic", "warn", "回答偏离主题或与上下文不相关", 4),
    ("relevance_incomplete_coverage", "warn", "上下文覆盖不完整，可能无法完整回答问题", 4),
]

# --- fixed values: verdict dimensions (dimension, rule prefix, priority) --------------------
DIMENSIONS = [
    ("safety", "safety", 1),
    ("factuality", "factuality", 2),
    ("answer_correctness", "factuality", 2),
    ("retrieval_quality", "retrieval", 3),
    ("relevance", "relevance", 4),
]

# --- fixed values: intervention texts ---------------------------------------------------------
BLOCK_MESSAGE = "抱歉，根据内容安全策略，无法展示此回答。"
WARN_SUFFIX = "\n\n---\n⚠️ 此回答内容可能存在问题，请谨慎参考。"
NO_RULE_REASON = "未找到匹配的干预规则"
INPUT_BLOCK_DETAIL = "输入安全审查未通过"
INPUT_BLOCK_REASON = "输入内容不符合安全规范，已拦截"

# --- fixed values: model prices per million tokens (model, input, output) -----------------------
PRICES = [
    ("qwen-plus", 0.80, 2.00),
    ("qwen-max", 2.00, 6.00),
    ("deepseek-v4-pro", 2.00, 8.00),
    ("deepseek-v4-flash", 0.30, 1.20),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("glm-4.7", 0.10, 0.10),
    ("glm-4v", 0.10, 0.10),
    ("embedding-3", 0.70, 0.00),
    ("text-embedding-v3", 0.70, 0.00),
]

# --- fixed values: latency histogram bounds in seconds --------------------------------------------
LATENCY_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]

# --- fixed values: default alert rules (metric, operator, threshold, label) -------------------------
ALERT_RULES = [
    ("cpu", "gt", 90.0, "CPU > 90%"),
    ("mem_pct", "gt", 90.0, "内存 > 90%"),
    ("disk_pct", "gt", 90.0, "磁盘 > 90%"),
    ("db_pool_pct", "lt", 20.0, "DB 连接池 < 20%"),
]
ALERT_GAP_SECONDS = 300

# --- fixed values: rate limits (requests, seconds) ----------------------------------------------------
RATE_LIMIT = (60, 60)
REGISTER_LIMIT = (3, 60)

# --- fixed values: role hierarchy -----------------------------------------------------------------------
ROLE_LEVELS = {"viewer": 0, "editor": 1, "tenant_admin": 2, "super_admin": 3}

# --- fixed values: default session title and summary labels -----------------------------------------------
DEFAULT_TITLE = "新对话"
SUMMARY_HEADER = "\n\n[对话历史摘要]\n"
EARLIER_HEADER = "\n[早期对话]\n"
USER_LABEL = "用户"
MODEL_LABEL = "AI"

# --- fixed values: expected keyword verdicts ------------------------------------------------------------------
KEYWORD_FAIL = 0.3
KEYWORD_PARTIAL = 0.7
