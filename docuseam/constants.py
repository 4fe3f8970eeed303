"""Fixed values that results depend on."""

# --- fixed values: sections -------------------------------------------------
SECTION_ORDER = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "reasoning", "facts", "claims", "defense", "judgment", "statutes"]
SECTION_WEIGHTS = {"fine_tags": 1.60, "fine_rule": 1.55, "focus_tags": 1.50, "focus_analysis": 1.45, "reasoning": 1.20, "facts": 1.00, "claims": 0.70, "defense": 0.85, "judgment": 0.75, "header": 0.40, "statutes": 0.45}
DEFAULT_SECTION_WEIGHT = 0.6
SECTION_TITLES = {"fine_tags": "细争点标签", "fine_rule": "裁判规则", "focus_tags": "焦点标签", "focus_analysis": "焦点评析", "claims": "诉称", "defense": "辩称", "facts": "查明事实", "reasoning": "本院认为", "judgment": "裁判结果", "statutes": "引用法条"}
KEY_SECTIONS = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "reasoning", "facts", "defense"]
LEGAL_SECTIONS = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "reasoning"]
FOCUS_SECTIONS = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis"]
RERANK_ORDER = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "reasoning", "facts", "claims", "judgment"]
RERANK_BUDGETS = {"fine_tags": 300, "fine_rule": 500, "focus_tags": 300, "focus_analysis": 700, "reasoning": 900, "facts": 320, "judgment": 240, "claims": 220, "defense": 220}
OTHER_BUDGET = 360
PASSAGE_LIMIT = 3600
RERANK_GROUPS = {"fine_tags": "【核心争议】", "fine_rule": "【核心争议】", "focus_tags": "【核心争议】", "focus_analysis": "【核心争议】", "reasoning": "【裁判规则】", "facts": "【关键事实】", "judgment": "【裁判结果】", "claims": "【诉请摘要】", "defense": "【抗辩摘要】"}
GROUP_ORDER = ["【案件画像】", "【核心争议】", "【裁判规则】", "【关键事实】", "【裁判结果】", "【诉请摘要】", "【抗辩摘要】", "【相关片段】"]
CASE_KEY_SECTIONS = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "reasoning", "facts"]
GUARDRAIL_LIMIT = 5000
GUARDRAIL_CHUNKS = 12
CHUNK_SIZES = {"claims": (760, 0), "defense": (760, 0), "facts": (900, 120), "reasoning": (900, 120)}
OTHER_CHUNK_SIZE = (1600, 0)

# --- fixed values: splitting --------------------------------------------------
FACT_BOUNDARY = r"(?=(?:19|20)\d{2}年\d{1,2}月\d{1,2}日)"
REASONING_BOUNDARY = r"(?=(?:本案争议焦点为|本院认为|首先|其次|再次|最后|关于|对于|故|综上))"
PLEADING_TAIL = r"当事人围绕诉讼请求依法提交了证据|本院组织当事人进行了证据交换|对当事人无异议的证据"
CLAIM_MARKER = r"(?:原告|上诉人|申请人|再审申请人|反诉原告)[^。；\n\r]{0,30}(?:诉称|补充陈述|上诉请求|请求)"
DEFENSE_MARKER = r"(?:被告|被上诉人|被申请人|第三人|反诉被告)[^。；\n\r]{0,30}(?:辩称|述称|答辩称)"

# --- fixed values: routes (name, type, weight, section) ----------------------
ROUTES = [
    ("bm25_raw", "bm25", 1.0, None), ("vector_raw", "vector", 0.8, None), ("bm25_focus", "bm25", 0.95, None), ("vector_focus", "vector", 1.20, None),
    ("bm25_fine_tags", "bm25", 1.20, "fine_tags"), ("bm25_fine_rule", "bm25", 1.30, "fine_rule"), ("bm25_focus_tags", "bm25", 1.60, "focus_tags"),
    ("bm25_focus_analysis", "bm25", 1.10, "focus_analysis"), ("bm25_reasoning", "bm25", 1.10, "reasoning"), ("bm25_facts", "bm25", 0.60, "facts"),
    ("bm25_negative", "bm25", 1.20, None), ("bm25_legal", "bm25", 0.80, None),
]

# --- fixed values: terms of query profiles -----------------------------------
NEGATIVE_TERMS = ["未", "没有", "无", "不能证明", "未举证", "不予支持", "不支持", "缺乏依据", "未约定", "未履行", "未完成", "未支付", "未返还", "未交付", "未办理", "未到庭", "未答辩", "不成立", "不存在", "无法证明", "证据不足", "否认收到", "主体不明", "未能证明", "拒绝支付", "未实际发货", "无真实交易合意", "预测订单", "刷单"]
REQUEST_TERMS = ["返还", "解除", "赔偿", "支付利息", "资金占用利息", "抵扣", "确认合同无效", "继续履行", "违约金", "定金", "租金", "押金", "赔偿损失", "承担责任", "驳回", "货款", "对账", "欠款", "发票", "增值税发票", "送货单", "交付", "收货", "质量问题", "举证责任", "表见代理", "合同相对方", "逾期利息", "违约金调整", "股东混同"]
DISPUTE_TERMS = ["争议", "焦点", "是否", "能否", "可否", "应否", "如何认定", "能不能", "支不支持", "支持", "不支持", "承担", "成立", "认定", "证明", "举证", "相对方", "表见代理", "质量", "抵扣", "对账", "短缺", "混同"]
RELATION_TERMS = ["委托合同", "买卖合同", "房屋租赁合同", "租赁合同", "借款合同", "服务合同", "劳动合同", "建设工程", "物业服务", "侵权责任", "合同解除", "违约责任", "不当得利", "民间借贷", "保证责任", "定金", "押金", "资金占用", "事实买卖合同", "口头买卖合同", "买卖合同关系", "承揽合同", "表见代理", "合同相对方"]
REASON_TERMS = ["委托合同纠纷", "买卖合同纠纷", "房屋租赁合同纠纷", "租赁合同纠纷", "金融借款合同纠纷", "民间借贷纠纷", "服务合同纠纷", "物业服务合同纠纷", "建设工程施工合同纠纷", "劳动合同纠纷", "不当得利纠纷", "侵权责任纠纷"]
SUPPORT_TERMS = ["予以支持", "应予支持", "支持", "准许", "成立"]
REJECT_TERMS = ["不予支持", "驳回", "不支持", "不成立", "缺乏依据"]

# --- fixed values: guardrails -------------------------------------------------
NEGATION_CUES = ["完全未涉及", "并未涉及", "未涉及", "不涉及", "未提及", "未载明", "未显示", "未体现", "未说明", "未论及", "未主张", "未请求", "没有", "并无", "均无", "不存在", "不包含", "未见", "未发现"]
NEGATION_SUFFIX = "无"
NEGATION_LOOKBACK = 18
REQUIRED_FACTORS = [
    {"name": "ownership_retention", "query_any": ["所有权保留", "取回权", "留置所有权"], "doc_any": ["所有权保留", "取回权", "返还货物", "留置所有权"], "penalty": 0.18},
    {"name": "deposit_penalty", "query_any": ["定金罚则", "成约定金", "违约定金", "返还定金"], "doc_any": ["定金罚则", "成约定金", "违约定金", "返还定金", "没收定金", "双倍返还定金"], "penalty": 0.12},
    {"name": "invoice_dispute", "query_any": ["发票争议", "未开票", "未开发票", "未开具发票", "拒开发票", "开票义务", "开具发票", "补开发票", "发票问题"], "doc_any": ["发票争议", "未开票", "开票", "发票", "增值税发票"], "penalty": 0.06},
    {"name": "third_party_supply", "query_any": ["第三方供货", "第三方代为供货", "第三人供货", "代为供货", "指示第三方"], "doc_any": ["第三方供货", "第三方代为供货", "第三人供货", "代为供货", "指示第三方", "第三人履行"], "penalty": 0.10},
    {"name": "reconciliation_silence", "query_all": ["对账单"], "query_any": ["未在合理期限", "未提出异议", "未及时提出异议", "视为认可", "结算依据"], "doc_any": ["对账单", "未提出异议", "未在合理期限", "结算依据", "对账", "结算单"], "penalty": 0.08},
    {"name": "seal_dispute", "query_any": ["偷盖", "冒盖", "私盖", "收货确认单", "合同外供货"], "doc_any": ["偷盖", "冒盖", "私盖", "印章", "收货确认单", "合同外供货", "盖章", "公章"], "penalty": 0.10},
    {"name": "oral_contract_evidence", "query_any": ["口头买卖", "微信聊天记录", "仅凭微信", "无书面合同"], "doc_any": ["口头买卖", "微信聊天记录", "无书面合同", "聊天记录", "微信"], "penalty": 0.10},
    {"name": "termination_time", "query_any": ["解除时间", "解除时间如何认定", "起诉状副本送达", "送达时解除"], "doc_any": ["解除时间", "起诉状副本送达", "送达时解除", "解除通知", "合同解除时间"], "penalty": 0.10},
    {"name": "agency_or_third_payment", "query_any": ["委托他人", "代付", "案外人", "以自己名义"], "doc_any": ["委托他人", "代付", "案外人", "以自己名义", "第三人付款", "第三人代付", "代为支付"], "penalty": 0.04},
]
CONFLICT_FACTORS = [
    {"name": "defective_delivery_vs_non_delivery", "query_any": ["瑕疵", "异物", "碎骨", "淤血", "淋巴", "质量"], "doc_any": ["未交货", "未发货", "未交付", "迟延交货", "逾期交货", "未履行交货"], "absent": ["瑕疵", "异物", "碎骨", "淤血", "淋巴", "质量"], "penalty": 0.14},
    {"name": "non_delivery_vs_defective_delivery", "query_any": ["未交货", "未发货", "未交付"], "doc_any": ["质量异议", "瑕疵", "异物", "质量问题"], "absent": ["未交货", "未发货", "未交付"], "penalty": 0.10},
    {"name": "buyer_default_vs_seller_default", "query_any": ["未按约提车", "拒收", "价格过高", "买方拒收", "买方未提货", "买方未按约"], "doc_any": ["卖方未交货", "出卖人未交货", "卖方未发货", "出卖人未发货", "卖方根本违约"], "absent": [], "penalty": 0.08},
    {"name": "collateral_invoice_only", "query_any": ["定金罚则", "所有权保留", "解除时间", "第三方供货"], "doc_any": ["发票", "开票"], "absent": ["定金罚则", "所有权保留", "解除时间", "第三方供货", "第三方代为供货"], "penalty": 0.04},
]

# --- fixed values: nested rows of a corpus and what is made of them -----------
NESTED_ROW = (
    "doc_id string, `案号` string, `法院` string, `审级` string, `案由` string, `裁判日期` string, `当事人` array<struct<`角色`:string,`名称`:string,`类型`:string>>, `法律关系` string, `标的物类型` string,"
    " `争议焦点` struct<`焦点标签`:array<string>,`焦点评析`:struct<`案情核心`:string,`法律争点`:string,`裁判要旨`:string>,`焦点原文`:string,`是否显式`:boolean>,"
    " `细争点` struct<`主叶子`:string,`细争点`:array<string>,`裁判规则争点`:string>, `裁判结果_标签` string,"
    " `引用法条` array<struct<`法律`:string,`条`:int,`原文`:string>>, `段落` struct<`诉称`:string,`查明事实`:string,`本院认为`:string,`裁判结果`:string>"
)
BUILD_ORDER = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "pleadings", "facts", "reasoning", "judgment", "statutes"]
CASE_TYPE = "民事"
DEFAULT_REASON = "买卖合同纠纷"
REGIONS = ["上海"]
QUALITY_FLAGS = ["caselaw_benchmark_structured"]
EMBEDDING_DIM = 1024
OTHER_STORED_WEIGHT = 1.0
