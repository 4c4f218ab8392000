"""Fixed values. They must equal those of the pipeline whose results this library matches; all of them are parameters of
the functions that use them."""

# Cleaning
MIN_TEXT = 20
MAX_TEXT = 8000
TRUNCATED = "..."
TAG = r"<[^>]+>"
PHONE = r"1[3-9]\d{9}"
ID_CARD = r"\d{17}[\dXx]"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
BANK_CARD = r"(?<!\d)\d{16,19}(?!\d)"
URL = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+"
PHONE_MASK, ID_MASK, EMAIL_MASK, CARD_MASK = "[手机号]", "[身份证号]", "[邮箱]", "[银行卡号]"
AD_PHRASES = [
    "点击查看", "立即下载", "扫码关注", "免费领取", "限时优惠", "加微信", "加QQ", "点击进入", "复制链接", "长按识别", "阅读原文",
    "更多精彩", "广告", "推广", "赞助商",
]
AD_HITS = 3
NEWS_TITLE = (5, 200)

# Quality filter
MIN_RESPONSE, MAX_RESPONSE, MIN_QUESTION, MIN_DISTINCT = 30, 8000, 5, 10
REFUSALS = ["作为AI", "作为一个AI", "作为人工智能", "我无法", "我不能", "抱歉，我", "很抱歉", "Sorry", "I cannot", "对不起，我无法"]
REFUSAL_HEAD = 100
NGRAM, SIMILAR = 5, 0.8
TASK_RATIO = {
    "stock_analysis": 0.20, "quant_strategy": 0.15, "financial_report": 0.20, "sentiment_analysis": 0.15, "financial_qa": 0.20,
    "risk_assessment": 0.10,
}

# Mixing
TRAIN_SHARE, SEED = 0.95, 42
TASK_CAP = {
    "stock_analysis": 20000, "quant_strategy": 15000, "financial_report": 20000, "sentiment_analysis": 15000, "financial_qa": 20000,
    "risk_assessment": 10000, "general": 15000,
}
DEFAULT_CAP = 20000

# Conversion
USER_ROLES, MODEL_ROLES = ["human", "user"], ["gpt", "assistant"]

# Evaluation
SENTIMENT = {
    "积极": "positive", "正面": "positive", "利好": "positive", "positive": "positive", "消极": "negative", "负面": "negative",
    "利空": "negative", "negative": "negative", "中性": "neutral", "中立": "neutral", "neutral": "neutral",
}
TASK_KEYWORDS = {
    "stock_analysis": ["趋势", "支撑", "压力", "MACD", "成交量", "均线"],
    "financial_report": ["营收", "净利润", "ROE", "同比", "现金流", "资产负债"],
    "financial_qa": [],
    "risk_assessment": ["风险", "评级", "波动", "建议", "因素"],
}
FINANCE_TERMS = [
    "收益率", "市盈率", "波动率", "资产", "负债", "净利润", "ROE", "MACD", "均线", "支撑", "压力", "策略", "风险", "收益", "估值", "因子",
    "回测", "Alpha",
]
CONCLUSIONS = ["综上", "总结", "总的来说", "建议", "注意"]
ANSWER_PATTERNS = [r"答案[是为：:\s]*([ABCD])", r"选[择项]?\s*([ABCD])", r"^([ABCD])[.、\)\s]", r"正确答案[是为：:\s]*([ABCD])"]
ANSWERS = ["A", "B", "C", "D", "AB", "BC", "CD", "ABC", "BCD", "ABCD"]  # the substrings of ABCD
MCQ_PROMPT = "请回答以下单选题，直接给出答案选项字母（A/B/C/D），不需要解释。\n\n题目：{question}\nA. {A}\nB. {B}\nC. {C}\nD. {D}\n\n答案："

# Prompts
TEMPLATES = {
    "stock_analysis": "以下是{stock_name}（{stock_code}）最近的行情数据摘要:\n{market_data}\n\n请从技术面角度分析该股票的走势，包括:\n1. K线形态分析\n2. 关键技术指标解读（MACD、KDJ、RSI等）\n3. 支撑位和压力位判断\n4. 短期趋势研判和操作建议",
    "quant_strategy": "基于以下A股市场数据特征:\n{market_context}\n\n请设计一个{strategy_type}量化交易策略，要求:\n1. 说明策略核心逻辑和因子选择依据\n2. 给出完整的 Python 实现代码（使用 pandas/numpy）\n3. 说明入场/出场条件和仓位管理规则\n4. 分析策略的风险点和适用市场环境",
    "financial_report": "以下是{company_name}（{stock_code}）最新一期的关键财务数据:\n{financial_data}\n\n请对该公司进行深度财务分析，包括:\n1. 盈利能力分析（ROE、毛利率、净利率等）\n2. 偿债能力评估（资产负债率、流动比率等）\n3. 运营效率分析（应收账款周转率等）\n4. 同比/环比变化趋势及异常信号\n5. 综合投资价值评估",
    "sentiment_analysis": "请分析以下金融新闻的情感倾向和市场影响:\n\n标题: {title}\n内容: {content}\n\n要求:\n1. 判断情感倾向（积极/中性/消极）并给出置信度\n2. 识别涉及的公司/行业/政策\n3. 评估对相关股票/板块的潜在影响（方向和程度）\n4. 给出关键依据",
    "financial_qa": "{question}",
    "risk_assessment": "以下是{company_name}（{stock_code}）的财务和市场数据:\n{risk_data}\n\n请进行全面的风险评估:\n1. 信用风险评估（违约概率、财务健康度）\n2. 市场风险评估（波动率、Beta、VaR估算）\n3. 行业风险因素\n4. 综合风险等级评定（低/中/高/极高）\n5. 风险缓释建议",
}
QUESTIONS = [
    "什么是市盈率（PE）？如何用市盈率判断股票估值是否合理？", "请解释股票市场中的做空机制是如何运作的？", "什么是夏普比率？如何用它来评估投资组合的表现？",
    "请解释A股市场的涨跌停板制度及其设计目的。", "什么是可转债？它的投资价值和风险有哪些？", "请解释什么是量化交易中的alpha和beta。",
    "CPI和PPI有什么区别？它们对股市有怎样的影响？", "什么是北向资金？为什么它被视为A股的风向标？", "请解释期权的四种基本策略（买入看涨、卖出看涨、买入看跌、卖出看跌）。",
    "什么是杜邦分析法？如何用它分析企业的ROE？", "什么是资产负债表中的商誉？商誉减值意味着什么？", "请解释什么是股票的技术分析和基本面分析，各自的优缺点是什么？",
    "什么是ETF基金？它与普通开放式基金有什么区别？", "请解释DCF（自由现金流折现）估值模型的基本原理和步骤。", "什么是融资融券？融资融券余额的变化对市场意味着什么？",
]
