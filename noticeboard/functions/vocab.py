"""Fixed values.

Word lists, patterns, weights and enumerations that must equal the ones the
platform publishes, otherwise results differ.  Everything here is plain data:
every operator takes these as default *arguments*, so a caller can pass other
dictionaries (the registered queries pass Latin ones).
"""

# --- fixed values: channel suggestion --------------------------------------
CHANNEL_OF_CONTENT_KIND = {
    "HEALTH_EDUCATION": "HEALTH",
    "ANTI_FRAUD": "FRAUD",
    "ELDERLY_SERVICE": "ELDERLY",
    "ACTIVITY_NOTICE": "ACTIVITY",
    "SERVICE_GUIDE": "SERVICES",
    "SERVICE_NOTICE": "SERVICES",
    "COMMUNITY_SERVICE": "COMMUNITY",
}
CHANNEL_WORDS = {
    "HEALTH": ["健康", "医疗", "医院", "门诊", "体检", "疫苗", "接种", "流感", "疾病", "就医", "卫生", "营养", "康复", "用药"],
    "ELDERLY": ["养老", "老年", "老龄", "银龄", "高龄", "长者", "助老", "退休", "护理", "适老化"],
    "MEALS": ["助餐", "用餐", "供餐", "餐卡", "食堂", "长者食堂", "送餐", "膳食"],
    "SERVICES": ["办理", "申请", "换领", "补办", "预约", "登记", "证件", "材料清单", "服务指南", "受理", "窗口", "资格", "申领"],
    "FRAUD": ["反诈", "诈骗", "骗局", "防骗", "电信网络诈骗", "可疑来电", "转账", "验证码", "资金安全"],
    "ACTIVITY": ["活动", "报名", "讲座", "课堂", "课程", "培训", "辅导", "展览", "演出", "招募", "志愿者"],
    "COMMUNITY": ["社区", "街道", "居委", "村委", "小区", "社区服务", "便民", "镇", "邻里", "公告", "通知"],
}
CHANNEL_TIE_ORDER = ["MEALS", "FRAUD", "HEALTH", "ELDERLY", "ACTIVITY", "SERVICES", "COMMUNITY"]
CHANNEL_LABELS = {
    "HEALTH": "健康", "ELDERLY": "养老", "MEALS": "助餐", "SERVICES": "办事",
    "FRAUD": "防诈", "ACTIVITY": "活动", "COMMUNITY": "社区",
}

# --- fixed values: content kind of an article ------------------------------
STRONG_TITLE_RULES = [
    ("ANTI_FRAUD", ["反诈", "防诈", "诈骗"]),
    ("HEALTH_EDUCATION", ["健康", "用药", "减重", "消暑", "就医"]),
    ("POLICY_NEWS", ["政策", "管理办法", "行动方案"]),
    ("SERVICE_NOTICE", ["报名通知", "办理通知", "申请通知"]),
]
CONTENT_KIND_RULES = [
    ("ANTI_FRAUD", ["诈骗", "反诈", "防诈", "验证码", "安全账户", "屏幕共享"]),
    ("HEALTH_EDUCATION", ["健康", "就医", "疾病", "用药", "减重", "消暑", "症状"]),
    ("POLICY_NEWS", ["政策", "民政部", "补贴", "行动方案", "管理办法", "网络建设"]),
    ("COMMUNITY_SERVICE", ["社区", "上门", "送餐", "助老", "志愿服务"]),
    ("SERVICE_NOTICE", ["报名", "办理", "申请", "受理时间", "所需材料"]),
]
CATEGORY_OF_CONTENT_KIND = {
    "HEALTH_EDUCATION": "健康",
    "POLICY_NEWS": "养老政策",
    "ANTI_FRAUD": "防诈",
    "COMMUNITY_SERVICE": "社区服务",
    "SERVICE_NOTICE": "办事通知",
}
DEFAULT_CATEGORY = "文化学习"

# --- fixed values: kind of a document --------------------------------------
DOCUMENT_KINDS = [
    "SERVICE_GUIDE", "ACTIVITY_NOTICE", "POLICY_DOCUMENT", "STANDARD_SPECIFICATION", "HEALTH_EDUCATION",
    "ANTI_FRAUD", "ELDERLY_SERVICE", "NEWS_ARTICLE", "GENERAL_PUBLIC_SERVICE",
]
DOCUMENT_KIND_SIGNALS = {
    "STANDARD_SPECIFICATION": ["标准编号", "本标准规定", "规范性引用文件", "术语和定义", "基本要求", "服务质量评价", "附录"],
    "POLICY_DOCUMENT": ["指导意见", "实施意见", "政策措施", "职责分工", "监督管理", "本通知自", "各有关单位"],
    "HEALTH_EDUCATION": ["健康提示", "危险因素", "预防", "症状", "及时就医", "健康教育", "不适症状"],
    "ANTI_FRAUD": ["诈骗", "反诈", "验证码", "转账", "陌生链接", "报警"],
    "ACTIVITY_NOTICE": ["活动时间", "活动地点", "报名时间", "报名方式", "每场限", "活动安排"],
    "SERVICE_GUIDE": ["办理条件", "申请材料", "办理流程", "办理地点", "受理时间", "申请人"],
    "ELDERLY_SERVICE": ["养老服务", "老年人", "助餐", "养老机构", "居家养老"],
    "NEWS_ARTICLE": ["记者", "新华社", "本报讯", "日电", "消息"],
}
SECTION_HEADING = (
    r"^(?:第[一二三四五六七八九十百]+[章节]|[一二三四五六七八九十]+[、.]|\d+(?:\.\d+){0,3}\s+|"
    r"(?:范围|术语和定义|规范性引用文件|基本要求|服务内容|服务流程|人员要求|场所要求|风险管理|质量评价|附录))"
)
SECTION_FACT_LABELS = {
    "STANDARD_SPECIFICATION": ["范围", "术语", "基本要求", "服务内容", "服务流程", "人员要求", "场所要求", "风险", "质量", "附录"],
    "POLICY_DOCUMENT": ["政策目标", "适用范围", "核心措施", "职责分工", "实施时间", "监督"],
    "HEALTH_EDUCATION": ["适用人群", "主要结论", "危险因素", "建议", "异常信号", "及时就医", "常见误区"],
}

# --- fixed values: document metadata ---------------------------------------
TITLE_WORDS = ["通知", "告知", "说明", "指南", "办法", "公告", "方案", "细则"]
SAMPLE_MATERIAL_MARK = "模拟材料"
PAGE_LINE_PREFIX = "第 "
PUBLISHER_LINE = (
    r"^(?!.*(?:预防接种门诊|服务窗口|综合服务台)$).{2,50}"
    r"(?:人民医院|医院|社区卫生服务中心|人民政府|委员会|管理局|服务中心)$"
)
DOCUMENT_NUMBER = r"[一-鿿]{1,12}〔\d{4}〕\d{1,4}号"
FILENAME_PREFIXES = [r"^模拟材料\s*\d*[_\-\s]*"]  # a platform adds its own brand prefix in front
SOURCE_TYPES = [
    (["社区卫生服务中心"], "基层医疗卫生机构"),
    (["医院"], "医疗机构"),
    (["政府", "委员会", "管理局"], "政府部门"),
]

# --- fixed values: page chrome, links, images ------------------------------
CHROME_WORDS = ["首页", "登录", "注册", "客户端下载", "相关推荐", "责任编辑", "版权所有", "网站地图"]
ARTICLE_PATH = r"(?i)(?:^|[-_/])(article|detail|content|news|notice|view|story|post)(?:[-_/.]|$)"
ARTICLE_QUERY_KEYS = ["articleid", "article_id", "contentid", "content_id", "docid", "doc_id", "infoid", "newsid", "postid"]
DIRECTORY_PATH = r"(?i)(?:^|[-_/])(category|categories|channel|directory|guide|index|list|nav|search|sitemap)(?:[-_/.]|$)"
DIRECTORY_QUERY_KEYS = ["cate", "category", "channel", "column", "dept", "department", "menu", "type"]
DATED_PATH = r"/20\d{2}/(?:0?[1-9]|1[0-2])(?:/|$)"
NAVIGATION_TITLES = [
    "首页", "返回首页", "政务公开", "信息公开", "信息公开目录", "按部门分类", "按主题分类", "上一页", "下一页", "更多",
    "更多信息", "网站地图", "联系我们", "登录", "注册", "home", "back", "previous", "next", "more", "menu", "navigation",
]
ROW_DATE = r"(?<!\d)(20\d{2})[-年/.](0?[1-9]|1[0-2])[-月/.](0?[1-9]|[12]\d|3[01])日?(?!\d)"
JSON_LD_ARTICLE_TYPES = ["Article", "NewsArticle", "ReportageNewsArticle", "BlogPosting"]
IMAGE_REJECT_WORDS = [
    "logo", "icon", "avatar", "qrcode", "qr-code", "tracking", "pixel", "advert", "广告", "二维码", "头像", "图标",
]
IMAGE_UNRELATED_WORDS = [
    "header", "footer", "navbar", "navigation", "sidebar", "download-app", "copyright", "login", "register",
    "页头", "页脚", "导航", "登录", "版权",
]
IMAGE_BASE_SCORE = {"OPEN_GRAPH": 80, "JSON_LD": 70, "ARTICLE_IMAGE": 10}
ACCOUNT_HOST = "mp.weixin.qq.com"
ACCOUNT_HINT_PATTERNS = {
    "account_biz": [
        r"""["']?biz["']?\s*[:=]\s*["']([^"']{4,160})""",
        r"""__biz=([^&"']+)""",
    ],
    "account_name": [
        r"""profile_nickname["']?\s*[:=]\s*["']([^"']{2,160})""",
        r"""<strong[^>]+class=["'][^"']*profile_nickname[^"']*["'][^>]*>(.*?)</strong>""",
        r"""<span[^>]+id=["']js_name["'][^>]*>(.*?)</span>""",
    ],
    "account_subject": [r"""account_subject["']?\s*[:=]\s*["']([^"']{2,160})"""],
}

# --- fixed values: resident relevance of a candidate -----------------------
RELEVANT_WORDS = [
    "养老", "助餐", "老年", "老人", "健康", "医保", "民政", "社区", "活动", "便民",
    "防诈", "反诈", "安全", "电梯", "停水", "停电", "交通", "疫苗", "就医", "办理",
]
IRRELEVANT_WORDS = [
    "送达公告", "采购", "招标", "行政处罚", "预算", "决算", "人事任免", "工作总结", "会议精神", "机关", "征求意见稿",
]
DEFAULT_TOPIC = "公共服务"
RELEVANCE_REASONS = {
    "HIGH": "与居民生活和适老公共服务高度相关",
    "LOW": "偏行政公示或机关事务，居民直接价值较低",
    "MEDIUM": "可能与本地公共服务相关，建议人工快速核对",
}

# --- fixed values: question answering --------------------------------------
QUESTION_STOP_CHARS = "的了和与及是有哪些什么怎么如何最近相关需要可以请问一下"
QUERY_CATEGORY_WORDS = ["时政", "健康", "养老", "反诈", "生活服务", "文化", "办事", "材料", "地点", "费用", "时间"]
QUERY_SYNONYMS = [
    ["办理", "申请", "申办"], ["材料", "证件", "资料"], ["时间", "日期", "期限", "截止"], ["地点", "地址", "窗口"],
    ["电话", "联系方式", "咨询"], ["费用", "收费", "金额", "免费"], ["老年", "老人", "银龄", "长者"], ["防诈", "诈骗", "反诈"],
]
ANCHOR_TOPICS = [
    ["健康", "卫生", "医疗", "体检", "疫苗"], ["养老", "老年", "老人", "银龄", "长者", "助餐"],
    ["防诈", "诈骗", "反诈"], ["办事", "办理", "申请", "申办"],
]
QUESTION_CATEGORIES = ["反诈", "健康", "养老", "办事", "费用", "材料", "地点", "时间"]
OTHER_CATEGORY = "其他"
COMMUNITY_WORDS = ["邻里", "邻居", "社区帖子", "居民发布", "互助信息", "拼车", "搭子"]
NEARBY_WORD = "附近"
NEARBY_TOPICS = ["活动", "互助", "闲置", "求助"]
STATUS_WORDS = ["运行状态", "服务状态", "助手状态", "系统正常吗", "能用吗"]
HIGH_RISK_WORDS = [
    "诊断", "症状", "治疗", "用药", "吃药", "剂量", "资格", "符合条件", "能不能申请", "可以申请吗", "金额", "补贴多少",
    "费用多少", "收费多少", "补贴", "电话", "联系方式", "咨询电话", "办理材料", "申请材料", "需要什么材料", "带什么证件",
    "法律", "投资", "收益", "转账",
]
WEAK_ANSWER_PHRASES = [
    "未提及", "未能提供", "没有找到", "无法回答", "没有明确", "证据未涉及", "证据仅涉及", "未在证据中", "未给出具体",
    "不涉及", "未包含", "无法确认", "未找到", "没有相关", "不包含", "证据不足", "未提供", "没有包含", "未涉及",
    "无法提供", "未收录", "未查询到", "没有可靠", "没有依据", "找不到相关",
]
GROUNDED_FACT_PATTERNS = [
    r"\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}月\d{1,2}日",
    r"\d{1,2}[:：]\d{2}(?:\s*[-—至]\s*\d{1,2}[:：]\d{2})?",
    r"(?:0\d{2,3}[-— ]?)?\d{7,8}",
    r"\d+(?:\.\d+)?\s*(?:元|万元|块)",
]
FACT_CARD_TYPES = {
    "START_DATE": "deadline", "END_DATE": "deadline", "LOCATION": "location",
    "CONTACT": "phone", "FEE": "fee", "MATERIAL": "material",
}
SUGGESTIONS = [
    ("反诈", "最近有哪些反诈提醒？"), ("养老", "有哪些适合老年人的办事指南？"),
    ("健康", "最近有哪些健康提醒？"), ("生活服务", "生活服务事项需要准备什么？"),
]
DEFAULT_SUGGESTION = "平台最近发布了哪些重要内容？"

# --- fixed values: ranking ---------------------------------------------------
HOT_WEIGHTS = {"pinned": 500, "importance": 5, "views": 3, "likes": 5, "favorites": 12, "reminders": 8}
CATEGORY_WEIGHTS = {"反诈": 40, "防诈": 40, "健康": 30, "养老": 20, "养老政策": 20}
DEFAULT_CATEGORY_WEIGHT = 10
COVER_SCORES = {
    "ORIGINAL_COVER": 30, "EDITOR_UPLOAD": 28, "UPLOADED_ORIGINAL": 28, "ARTICLE_IMAGE": 25, "PDF_FIRST_PAGE": 18,
}
NEWS_CATEGORIES = ["时政", "健康", "反诈", "文化", "养老政策", "防诈", "社区服务", "文化学习"]
CHANNEL_ALIASES = {
    "养老政策": ["养老", "养老政策"],
    "防诈": ["反诈", "防诈"],
    "社区服务": ["生活服务", "社区服务", "时政"],
    "文化学习": ["文化", "文化学习"],
}
RECOMMEND_CHANNEL = "推荐"
ACTIVITY_TEXT = r"活动|报名|开放日|讲座|辅导|场次"
ALERT_TITLE = r"紧急|重要提醒|反诈|诈骗|截止|暂停|风险提示"
SERVICE_KIND_PATTERNS = {
    "health": r"健康|卫生|医疗|体检|疫苗|医院",
    "meals": r"助餐|食堂|用餐|餐饮",
    "contacts": r".",
    "activities": r"活动|报名|讲座|课堂|开放日",
    "guides": r"办事|办理|材料|申请|换领",
}
SERVICE_CATEGORIES = ["养老", "生活服务", "健康", "社区服务", "办事通知"]
TEST_TITLE = r"(?i)(smoke|test|demo|mock|fixture|示例|演示|模拟|测试)"
SITE_NAME_SUFFIX = r"(?i)\s*[-_—|｜]\s*(新华网|人民网|央视网|中国政府网|中新网|光明网)\s*$"

# --- fixed values: rule channel ---------------------------------------------
RULE_CHANNELS = [
    ("HEALTH", r"健康|卫生|医疗|体检|疫苗|HEALTH"),
    ("ELDERLY", r"养老|助老|长者|老年|银龄|ELDERLY"),
    ("MEALS", r"助餐|食堂|用餐|餐饮|MEALS"),
    ("FRAUD", r"反诈|诈骗|FRAUD"),
    ("ACTIVITY", r"活动|报名|讲座|ACTIVITY"),
    ("SERVICES", r"办事|办理|材料|SERVICE_NOTICE|SERVICES"),
]
# (channel, category word, content kind or None, title words)
MIGRATION_CHANNELS = [
    ("HEALTH", "健康", "HEALTH_EDUCATION", []),
    ("ELDERLY", "养老", "ELDERLY_POLICY", []),
    ("MEALS", "助餐", None, ["食堂", "助餐"]),
    ("FRAUD", "反诈", "ANTI_FRAUD", []),
    ("ACTIVITY", "活动", None, ["活动", "报名"]),
    ("SERVICES", "办事", "SERVICE_NOTICE", []),
]

# --- fixed values: regions -----------------------------------------------------
REGIONS = [
    ("上海市", "上海市", "宝山区", "大场镇", "310113102"),
    ("上海市", "上海市", "宝山区", "顾村镇", "310113109"),
    ("上海市", "上海市", "宝山区", "庙行镇", "310113112"),
]
DEFAULT_REGION_CODE = "310113102"
NATIONAL_PROVINCE = "全国"
TOWN_SCOPES = ["LOCAL_TOWN", "TOWN", "STREET", "LOCAL"]
SHARED_CODES = {"DISTRICT_SHARED": "310113", "CITY_SHARED": "310000", "NATIONAL_SHARED": "100000"}

# --- fixed values: extracted facts ---------------------------------------------
FIELD_TYPES = [
    "TARGET_AUDIENCE", "ELIGIBILITY", "START_DATE", "END_DATE", "EVENT_DATE", "SERVICE_TIME", "LOCATION", "CONTACT",
    "FEE", "MATERIAL", "WARNING", "RESULT_TIME",
]
FIELD_TYPE_ALIASES = {
    "AUDIENCE": "TARGET_AUDIENCE", "TARGET_GROUP": "TARGET_AUDIENCE", "QUALIFICATION": "ELIGIBILITY",
    "DATE_START": "START_DATE", "DATE_END": "END_DATE", "ADDRESS": "LOCATION", "PHONE": "CONTACT", "COST": "FEE",
    "MATERIALS": "MATERIAL", "RISK": "WARNING",
}
DEADLINE_TYPE_ALIASES = {
    "FIXED": "FIXED_DATE", "DATE": "FIXED_DATE", "RELATIVE": "RELATIVE_PERIOD", "CAPACITY": "CAPACITY_LIMIT",
    "NONE": "NO_FIXED_DATE", "CHANNEL": "CHANNEL_SPECIFIC",
}
FACT_KEYS = ["field_type", "label", "value", "source_quote", "page_no", "segment_id", "confidence", "needs_human_review"]
TEMPORAL_TYPES = ["START_DATE", "END_DATE", "EVENT_DATE", "SERVICE_TIME"]
SUMMARY_TYPE_ORDER = [
    "TARGET_AUDIENCE", "ELIGIBILITY", "START_DATE", "END_DATE", "EVENT_DATE", "SERVICE_TIME", "LOCATION", "MATERIAL",
    "FEE", "CONTACT", "WARNING",
]
STEP_TITLES = [
    ("MATERIAL", "准备需要的材料"), ("START_DATE", "确认开始时间"), ("END_DATE", "确认截止时间"),
    ("LOCATION", "确认办理或活动地点"), ("CONTACT", "需要时联系咨询"),
]
SESSION_DATE = r"\d{4}年\d{1,2}月\d{1,2}日"
SESSION_TIME = r"\d{2}:\d{2}\s*[-—至]\s*\d{2}:\d{2}"
SESSION_PLACE = r"[^\r\n。；]{2,80}(?:门诊|窗口|服务台|中心|地点)"
WEEKDAYS = r"(?:周|星期)[一二三四五六日天](?:[、，,](?:周|星期)[一二三四五六日天])*"
TIME_RANGE = r"\d{1,2}:\d{2}\s*[-—至]\s*\d{1,2}:\d{2}"
CLOSED_WORD = "不开放"
CLOSED_NOTE = "下午不开放"
FEE_BODY = r"[^\r\n。]{1,160}(?:\d+(?:\.\d+)?元|按[^；。\r\n]{1,50}收取)[^\r\n。]*"
FEE_PAYMENT = r"支持[^。\r\n]+支付"
FEE_AMOUNT_CLAUSE = r"^\s*(.+?)(每(?:证|次|人)?\s*\d+(?:\.\d+)?元|\d+(?:\.\d+)?元(?:/[^；，。]+)?)\s*$"
FEE_RULE_CLAUSE = r"^\s*(.+?)按(.+?收取)\s*$"
FEE_NAME_SUFFIX = r"(?:工本费|服务费|费用|费)$"
DATE_TOKEN = r"(?:\d{4}年)?\d{1,2}月\d{1,2}日"
DATE_ADJUSTMENT = rf"原预约日期为\s*({DATE_TOKEN})\s*的[，,]?\s*(?:顺延|调整|改期|变更)(?:至|为)\s*({DATE_TOKEN})"
DEADLINE = rf"({DATE_TOKEN}\s*\d{{1,2}}:\d{{2}}\s*(?:以前|之前|前|截止))"
AUDIENCE_SPLIT = r"^(.+?年满\d+周岁)[、，,](目前.+?)(?:者)?$"
NEWS_WARNING_WORDS = ["不可", "不要", "请勿", "避免", "不会", "谨防", "及时就医", "及时报警"]
NEWS_SERVICE_WORDS = ["开放", "服务时间", "办理时间", "延时服务"]
# as [^。！？\r\n], but as an intersection: the engine tests every character against a union one alternative after another
NEWS_SENTENCE = r"[[^\r\n]&&[^。！？]]+[。！？]?"
# field type -> ordered (pattern, value group index or literal value)
GUIDE_PATTERNS = {
    "TARGET_AUDIENCE": [
        (r"本街道常住居民，原则上年龄为(\d+周岁及以上)", 1),
        (r"补贴对象为(具有本市户籍且年满八十周岁的老年人)", 1),
        (r"(具有本市户籍且年满\s*80\s*周岁的老年人)", 1),
    ],
    "ELIGIBILITY": [(r"(已享受同类补贴待遇的，不重复发放)", "未享受同类生活补贴")],
    "START_DATE": [(r"报名时间为(\d{4}年\d{1,2}月\d{1,2}日)至(\d{1,2}月\d{1,2}日)", 1)],
    "END_DATE": [(r"报名时间为(\d{4}年)\d{1,2}月\d{1,2}日至(\d{1,2}月\d{1,2}日)", (1, 2))],
    "LOCATION": [
        (r"(浦江街道社区服务中心201教室)", 1),
        (r"(户籍所在地社区服务窗口)", 1),
        (r"(?:办理地点|活动地点)[：:\s]*([^\n；。]+)", 1),
    ],
    "FEE": [(r"(活动不收取任何费用)", "免费"), (r"(免费)", "免费")],
    "CONTACT": [(r"(?:咨询电话[：:]?)?(0\d{2,3}-(?:\d{3,4}-?\d{4}|\d{5,8}))", 1)],
    "MATERIAL": [
        (r"(本人日常使用的智能手机、充电线，以及用于现场核对报名信息的身份证)", "智能手机、充电线、身份证"),
        (r"(申请材料：身份证及户口簿原件、本人银行卡复印件、近期一寸免冠照片一张)", "身份证、户口簿、本人银行卡、近期一寸照片"),
        (r"(?:需携带|所需材料|申请材料)[：:]\s*([^\n。；]+)", 1),
    ],
    "WARNING": [
        (r"(不要求\s*提供银行卡、支付密码或短信验证码)", "不提供银行卡、支付密码或短信验证码"),
        (r"(不需要银行卡、支付密码或短信验证码)", "不提供银行卡、支付密码或短信验证码"),
    ],
}
GUIDE_LABELS = {
    "TARGET_AUDIENCE": "适用对象", "ELIGIBILITY": "申请条件", "START_DATE": "报名开始日期", "END_DATE": "报名截止日期",
    "LOCATION": "办理地点", "FEE": "费用", "CONTACT": "联系方式", "MATERIAL": "所需材料", "WARNING": "风险提示",
}

# --- fixed values: sources ------------------------------------------------------
USAGE_EVENT_TYPES = ["CONTENT_LISTEN", "SERVICE_PHONE_CLICK", "SERVICE_ADDRESS_COPY"]
REMINDER_TYPES = ["CONTENT_TIME", "DEADLINE", "ACTIVITY_START"]
STATUS_GROUPS = {
    "PENDING": ["UPLOADED", "PROCESSING"],
    "WAITING_REVIEW": ["WAITING_REVIEW"],
    "WAITING_PUBLISH": ["REVIEWED"],
    "PUBLISHED": ["PUBLISHED"],
    "EXCEPTION": ["FAILED", "WITHDRAWN"],
}
COVERAGE_TARGETS = {c: 5 for c in ["HEALTH", "ELDERLY", "MEALS", "SERVICES", "FRAUD", "ACTIVITY", "COMMUNITY"]}
RECOMMEND_TARGET = 20
REDACTED = "[已脱敏]"
DEFAULT_ERROR_SUMMARY = "处理失败"

# --- fixed values: source registry ---------------------------------------------
SOURCE_REGISTRY_TYPES = [
    "GOVERNMENT", "PUBLIC_INSTITUTION", "HOSPITAL", "COMMUNITY_HEALTH", "CDC", "ELDERLY_SERVICE_ORG", "OFFICIAL_MEDIA",
    "OFFICIAL_WECHAT", "UNIVERSITY_PUBLIC_SERVICE", "OTHER_VERIFIED_OFFICIAL",
]
DISCOVERY_MODES = ["MANUAL", "RSS", "ATOM", "SITEMAP", "SECTION", "MIXED"]
SCHEDULE_MODES = ["DAILY", "INTERVAL"]
DUPLICATE_STRATEGIES = ["SKIP", "CREATE_VERSION"]
IMAGE_POLICIES = ["MANUAL_REVIEW", "ORGANIZATION_OWNED", "OFFICIAL_PUBLICITY", "AUTHORIZED", "LOCAL_DEMO_CONFIRMED"]
RECENT_DAYS = [1, 3, 7, 30]
DEFAULT_ZONE = "Asia/Shanghai"
DEFAULT_CRAWL_TIME = "03:30"


# fixed values: sentences of a guide's digest; {NAMES} are field values, a [part] is left out when one of its values is missing
ACTIVITY_SECTION = r"(?s)活动时间与地点.*?(?=辅导内容|\z)"
GUIDE_MENTIONS = {"TIME": r"(\d{2}:\d{2}-\d{2}:\d{2})", "CAPACITY": r"(每场限\d+人)"}
GUIDE_TEMPLATES = {
    "activity": ["{DATES}[ {TIME}]"],
    "summary": ["{TARGET_AUDIENCE}可以按通知参加或申请。", "办理时间为{START_DATE}至{END_DATE}。", "活动安排在{ACTIVITY}[，{CAPACITY}]。", "地点为{LOCATION}。", "请携带{MATERIAL}。"],
    "steps": ["在规定时间报名：{START_DATE}至{END_DATE}完成报名。", "准备材料：准备{MATERIAL}。", "按时到场：[在{ACTIVITY}]前往{LOCATION}。"],
    "lines": ["活动日期：{DATES}", "活动时间：{TIME}", "{CAPACITY}"],
    "no_summary": ["暂未从材料正文中识别出结构化字段，请人工核对原文。"],
    "no_text": ["待人工填写。"],
}
NO_NEWS_SUMMARY = "暂未从材料正文中识别出可展示内容，请人工核对原文。"

# fixed values: what makes the extracted text of a page usable (characters, readable share, replacement and garbage shares)
PAGE_GOOD = {"chars": 12, "valid": 0.65, "repl": 0.02, "garbage": 0.08}
PAGE_UNCERTAIN = {"chars": 5, "valid": 0.4, "repl": 0.1, "garbage": 0.2}
#: an image that fills this share of a page with fewer characters makes it thin
PAGE_THIN = {"image": 0.35, "chars": 80}
PAGE_WEIGHTS = {"length": 0.25, "valid": 0.4, "chinese": 0.15, "repl": -0.5, "garbage": -0.4, "thin": -0.18}
PAGE_FULL_CHARS = 120.0
