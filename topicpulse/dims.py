"""Fixed dimensions: taxonomy, keywords, labels and platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_CATEGORY = "行业洞察"
FALLBACK_SUBCATEGORY = "综合"
UNCATEGORISED = "未分类"

# The category tree with example demands.
TAXONOMY: dict[str, tuple[list[str], list[str]]] = {
    "沟通协作": (
        ["跨部门沟通", "远程协作", "会议效率", "信息同步", "文档协作"],
        ["跨部门项目沟通困难", "远程团队协作工具选择", "会议过多影响工作"],
    ),
    "职业发展": (
        ["晋升路径", "技能提升", "转行转岗", "职业规划", "学习成长"],
        ["技术转管理的困惑", "35岁职业危机", "如何制定职业规划"],
    ),
    "求职面试": (
        ["简历优化", "面试技巧", "offer选择", "背景调查", "薪资谈判"],
        ["如何准备技术面试", "多个offer如何选择", "简历石沉大海"],
    ),
    "团队管理": (
        ["领导力", "团队建设", "绩效管理", "冲突处理", "人才培养"],
        ["新晋管理者如何带团队", "如何处理团队冲突", "绩效考核不公平"],
    ),
    "职场情绪": (
        ["压力管理", "职业倦怠", "焦虑抑郁", "工作生活平衡", "心理调适"],
        ["加班导致身心俱疲", "对工作失去热情", "职场PUA导致焦虑"],
    ),
    "职场关系": (
        ["上下级关系", "同事相处", "办公室政治", "职场社交", "边界感"],
        ["如何与难相处的上司沟通", "同事抢功劳", "职场中被孤立"],
    ),
    "工作效率": (
        ["时间管理", "工具方法", "流程优化", "专注力", "自动化"],
        ["总是无法按时完成任务", "如何提高专注力", "重复工作太多"],
    ),
    "薪酬福利": (
        ["薪资水平", "福利待遇", "股权期权", "加班补偿", "社保公积金"],
        ["同岗不同酬", "年终奖缩水", "加班没有加班费"],
    ),
    "行业洞察": (
        ["行业趋势", "技术变革", "政策影响", "市场分析", "AI影响"],
        ["AI会取代哪些岗位", "互联网行业还值得进入吗", "新能源行业前景"],
    ),
}

# Keyword lists per (category, subcategory); earlier entries win ties.
KEYWORDS: list[tuple[str, str, list[str]]] = [
    ("职业发展", "晋升加薪", ["升职", "加薪", "晋升", "涨薪", "薪资", "薪酬", "待遇"]),
    ("职业发展", "跳槽求职", ["跳槽", "求职", "面试", "简历", "offer", "招聘", "转行"]),
    ("职业发展", "职业规划", ["职业规划", "职业发展", "职业路径", "发展方向", "转型"]),
    ("职场技能", "沟通协作", ["沟通", "协作", "汇报", "表达", "演讲", "谈判", "人际"]),
    ("职场技能", "管理领导", ["管理", "领导力", "团队管理", "带团队", "下属", "leader"]),
    ("职场技能", "专业技能", ["技能", "学习", "培训", "考证", "提升", "能力"]),
    ("职场文化", "办公室政治", ["办公室政治", "站队", "派系", "关系", "背锅", "甩锅"]),
    ("职场文化", "企业文化", ["企业文化", "价值观", "使命", "加班文化", "狼性", "内卷"]),
    ("职场文化", "职场关系", ["同事关系", "上下级", "职场社交", "人脉", "圈子"]),
    ("工作生活", "工作压力", ["压力", "焦虑", "倦怠", "burnout", "996", "加班", "过劳"]),
    ("工作生活", "工作生活平衡", ["work-life", "平衡", "休假", "远程办公", "居家办公", "灵活"]),
    ("工作生活", "心理健康", ["心理", "情绪", "抑郁", "心态", "调节", "减压"]),
    ("行业洞察", "行业趋势", ["趋势", "风口", "赛道", "行业", "市场", "前景"]),
    ("行业洞察", "裁员就业", ["裁员", "失业", "就业", "优化", "毕业", "35岁"]),
    ("行业洞察", "综合", ["职场", "工作", "打工"]),
]

# Topic keywords that mark an article as relevant.
PRIMARY_KEYWORDS = ["职场", "工作", "跳槽", "面试", "升职", "加薪", "辞职", "管理", "领导力", "团队"]
SECONDARY_KEYWORDS = [
    "职业规划", "职业发展", "工作压力", "职场沟通", "办公室政治",
    "远程办公", "内卷", "35岁", "裁员", "绩效",
]

# Fixed values: (domain, key, zh label, en label).
LABELS: list[tuple[str, str, str, str]] = [
    ("category", "沟通协作", "沟通协作", "Communication & Collaboration"),
    ("category", "职业发展", "职业发展", "Career Development"),
    ("category", "求职面试", "求职面试", "Job Seeking & Interviews"),
    ("category", "团队管理", "团队管理", "Team Management"),
    ("category", "职场情绪", "职场情绪", "Workplace Emotions"),
    ("category", "职场关系", "职场关系", "Workplace Relationships"),
    ("category", "工作效率", "工作效率", "Work Efficiency"),
    ("category", "薪酬福利", "薪酬福利", "Compensation & Benefits"),
    ("category", "行业洞察", "行业洞察", "Industry Insights"),
    ("status", "new", "新发现", "New"),
    ("status", "confirmed", "已确认", "Confirmed"),
    ("status", "archived", "已归档", "Archived"),
    ("status", "rejected", "已拒绝", "Rejected"),
    ("status", "merged", "已合并", "Merged"),
    ("trend", "rising", "上升", "Rising"),
    ("trend", "stable", "平稳", "Stable"),
    ("trend", "declining", "下降", "Declining"),
]

# Known platforms and whether they are switched on by default.
PLATFORMS: list[tuple[str, bool]] = [
    ("zhihu", True),
    ("kr36", False),
    ("huxiu", False),
    ("juejin", False),
    ("toutiao", False),
    ("douban", False),
    ("xiaohongshu", False),
    ("bilibili", False),
    ("weixin_sogou", False),
    ("maimai", False),
    ("baidu_baijiahao", False),
    ("rss_generic", False),
]

VALID_CATEGORIES = list(TAXONOMY)
TOPIC_KEYWORDS = PRIMARY_KEYWORDS + SECONDARY_KEYWORDS


def inline_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A literal table inside the plan: its size is known, so joins broadcast it."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def taxonomy(spark: SparkSession) -> DataFrame:
    """One row per (category, subcategory)."""
    rows = [
        (category, sub, i, j, " | ".join(examples))
        for i, (category, (subs, examples)) in enumerate(TAXONOMY.items())
        for j, sub in enumerate(subs)
    ]
    return inline_rows(spark, rows, ["category", "subcategory", "category_ord", "sub_ord", "examples"])


def labels(spark: SparkSession) -> DataFrame:
    """One row per (domain, key, lang)."""
    rows = [
        (domain, key, lang, label)
        for domain, key, zh, en in LABELS
        for lang, label in (("zh", zh), ("en", en))
    ]
    return inline_rows(spark, rows, ["domain", "key", "lang", "label"])


def platforms(spark: SparkSession, enabled: dict[str, bool] | None = None) -> DataFrame:
    """Platform switches: the defaults, or the caller's own."""
    rows = list((enabled or dict(PLATFORMS)).items())
    return inline_rows(spark, rows, ["platform", "enabled"])
