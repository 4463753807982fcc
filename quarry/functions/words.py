"""Words, patterns and weights that the rules over questions work with."""

from __future__ import annotations

IMAGE = (
    "图", "图片", "图像", "照片", "截图", "画面", "看图", "图里", "图中", "这张图", "这幅图", "ocr", "识别", "图片文字",
    "文字识别", "识别图", "内容描述", "图像描述", "视觉描述", "画了什么", "有什么内容",
)
TEXT = ("文档", "章节", "文章", "这本书", "说明书", "资料", "参数", "配置")
IMAGE_SUFFIXES = ("图片内容", "图像描述", "图片文字", "ocr文字", "画面信息")
JOINT_BOTH = ("既有", "也有", "同时", "一起", "以及", "又有", "既包含", "也包含")
JOINT_IMAGE = ("图片", "图像", "照片", "截图")
JOINT_TEXT = ("书籍", "文档", "内容", "正文", "资料")
MULTI_DOC = ("共同", "分别", "各自", "区别", "不同", "相同", "比较", "相比", "对比", "优势", "特点", "目标", "哪些专业", "哪个专业", "哪几个专业")
CONNECTORS = ("与", "和", "及", "以及", "、")
TEMPORAL = ("时间", "日期", "哪一年", "哪年", "何时", "什么时候", "几月", "几号", "多久", "截至", "截止", "开始", "结束", "报名", "查询")
RECENT = ("最新", "当前", "目前", "现任", "最近", "今年", "本年", "本年度")
SEEKING = (
    "多少", "几", "谁", "哪位", "何人", "哪一年", "哪年", "何时", "什么时候", "开始时间", "什么时间", "什么等级", "被评为",
    "哪三个", "哪几", "哪些", "哪个", "是什么", "是怎样", "理念", "愿景", "定位", "目标", "对象", "政策",
)
LABELS = ("办学理念", "办学愿景", "发展定位", "人才培养目标", "降分政策", "招生人数", "招生计划", "开始时间", "招生对象", "定向招收对象", "办学目标", "等级")
EXTRACTIVE = ("多少", "几", "哪一年", "哪年", "何时", "什么时候", "开始时间", "什么时间", "什么等级", "哪三个")

# time series
SERIES = (
    "时间序列", "趋势", "变化", "波动", "异常", "峰值", "谷值", "最高", "最低", "更高", "更低", "拐点", "上升", "下降", "连续",
    "走势", "监测", "曲线", "浓度", "序列", "回落", "改善", "缓解", "异常", "抖动", "恶化", "恢复", "风险", "风险来源", "原因",
    "为什么", "解释", "依据", "峰值时间", "谷值时间", "最高值", "最低值", "幅度", "对比", "比较", "同步", "冲高", "改善幅度", "回落幅度",
)
SERIES_WINDOW = ("某时间段", "时间窗口", "时间范围", "期间", "区间", "至", "到", "前后", "之后", "以前", "以来")
SERIES_CHANNEL = ("pm25", "pm2.5", "pm10", "o3", "so2", "no2", "co", "latency", "latency_ms", "error_rate", "qps", "臭氧", "延迟", "错误率")
SERIES_DOMAIN = (
    "空气质量", "空气", "臭氧", "颗粒物", "pm2.5", "pm25", "pm10", "订单服务", "订单", "在线服务", "服务", "接口", "服务稳定性",
    "延迟", "错误率", "缓存命中率", "缓存", "回滚", "发布", "版本变更", "服务抖动", "高温", "静稳", "阵雨", "海风",
)
SERIES_GUARD = ("只看", "不要混入", "不要混进", "不要带入", "不要混", "不要掺入")
SERIES_CAUSAL = (
    "为什么", "原因", "由什么导致", "导致", "驱动", "解释", "依据", "风险来源", "业务判断", "抬头", "缓解", "改善", "恶化", "恢复",
    "回滚后", "发布后", "降雨后", "高温后",
)
SERIES_COMPARISON = ("更高", "更低", "大于", "小于", "高于", "低于", "比较", "对比", "是否", "哪一天", "哪个更", "哪段时间", "同步", "幅度")
LOCATION = "(?:北京|上海|苏州|南京|杭州|广州|深圳|天津|重庆|成都|武汉|西安|长沙|郑州|青岛|宁波)|[一-鿿]{2,10}(?:市|省|区|县)"
LOCATION_ELSE = "[一-鿿]{2,}(?:市|省|区|县)?"
CHANNEL = "(?:pm2\\.5|pm25|pm10|so2|no2|co|o3|温度|湿度|风速|latency(?:_ms)?|error_rate|qps)"
BACKGROUND = ("原因", "背景", "事件", "为什么", "影响", "依据", "缓解", "加重", "改善", "恢复", "回滚", "发布", "风险", "风险来源", "业务判断", "业务简报", "值班", "解释")
TREND = (
    "趋势", "变化", "回落", "下降", "上升", "波动", "峰值", "谷值", "监测", "浓度", "序列", "更高", "更低", "幅度", "同步", "比较",
    "判断", "解释", "对比", "哪一天", "风险", "异常", "抖动", "恢复", "恶化",
)
EVENTS = (
    "空气质量监测", "冷空气", "扩散条件", "污染物", "短时累积", "臭氧", "高温", "静稳", "海风", "阵雨", "订单服务", "在线服务监测",
    "在线服务", "缓存命中率", "缓存", "回滚", "版本变更", "发布", "服务抖动",
)
JOINT_WHY = ("原因", "为什么", "依据", "解释", "风险", "恢复", "改善")

# rewriting
SLOTS = ("报名时间", "截止时间", "查询时间", "开始时间", "结束时间", "工作时间", "测试时间", "发布时间", "更新时间", "录取时间", "成绩查询", "确认志愿")
KEPT = ("时间", "日期", "何时", "什么时候", "哪一年", "哪年", "几月", "几号", "截至", "截止", "开始", "结束", "报名", "查询")
COMPARING = ("共同", "区别", "不同", "相同", "相似", "异同", "差异", "比较", "对比")
RELATING = ("与", "和", "及", "以及")
QUERY_PREFIXES = ("检索查询：", "检索词：", "重写后：", "改写后：", "query:", "Query:")

# answers
QUESTION_MARKS = ("问题：", "问题:", "请回答：", "请回答:", "问：", "问:")
REQUIREMENT_CUTS = ("；", ";", "。", "\n")
REQUIREMENT_JOINS = ("分别", "同时", "以及", "并且", "还要", "此外")
DIRECT = ("谁", "哪位", "哪个", "是什么", "多少", "几", "哪一年", "哪年", "何时", "什么时候", "什么时间", "现任", "当前", "最新")
PROCEDURAL = ("步骤", "流程", "如何", "怎么", "怎样", "拆卸", "安装", "更换", "检查", "测量", "调整", "操作")
NUMERIC = ("多少", "几", "数值", "标准值", "范围", "扭矩", "压力", "间隙", "规格", "尺寸", "厚度", "温度", "电压", "电流")
MEANING = ("分别表示什么", "表示什么", "分别代表什么", "代表什么", "含义是什么", "什么意思")
SYMBOLS = ("IN", "EX", "L", "M", "A", "B", "C", "D")
ANSWER_RELATING = ("与", "和", "及", "以及", "对比", "比较")
ANSWER_COMPARING = ("共同", "区别", "不同", "相同", "相似", "异同", "差异", "特点", "特征", "分别", "各自", "对比", "比较")
ENTITIES = ("专业", "学院", "方向", "项目")
MULTI_PART = ("分别", "同时", "以及", "并且", "共同", "区别", "不同", "相同", "哪些", "哪几", "包括", "原因", "措施", "步骤")
SINGLE_FACT = ("多少", "几", "哪一年", "哪年", "何时", "什么时候", "什么时间", "哪个", "是什么")

# support of an answer
AMOUNT = "(?:\\d+|[零一二三四五六七八九十百千万两〇]+)\\s*(?:人|项|家|篇|分|个|所|名|种|门|届|年|月|日|级)"
GRADE = "(?i)(?:A\\+|A-|A|B\\+|B-|B|C\\+|C-|C|甲类|乙类|丙类)"
HOW_MANY = ("多少", "几", "几项", "几家", "几篇", "多少人", "招收多少", "降多少")
WHEN = ("哪一年", "哪年", "何时", "什么时候", "开始时间", "什么时间")
RATED = ("被评为", "评为", "获评")
WHO = ("谁", "哪位", "何人")
ROLES = ("校长", "院长", "主任", "书记", "负责人", "创办", "成立")
LANGUAGES = ("汉语", "中文", "英语", "英文", "法语", "法文", "德语", "日语", "俄语")
LISTING = ("哪些", "哪三个", "哪几", "包括哪些")
LIST_MARKS = ("、", "；", ";", "以及", "分别")

# weights by kind of question: modalities in the order of preference, extensions, hints
MODALITY_BONUS = {
    "none": {"text": 0.04, "ocr": 0.0, "vision": -0.02, "ocr+vision": -0.01, "image": -0.02},
    "timeseries_related": {"timeseries": 0.08, "text": 0.03, "ocr": 0.0, "ocr+vision": -0.01, "vision": -0.02, "image": -0.02},
    "multimodal_joint": {"text": 0.04, "ocr": 0.04, "ocr+vision": 0.05, "vision": 0.04, "image": 0.04},
    "image_related": {"ocr": 0.05, "vision": 0.05, "ocr+vision": 0.06, "image": 0.03, "text": 0.0},
    "text_related": {"text": 0.05, "ocr": 0.02, "ocr+vision": 0.01, "vision": -0.02, "image": -0.02},
}
PREFERRED = {
    "none": ("text",),
    "timeseries_related": ("timeseries", "text", "ocr", "ocr+vision", "vision", "image"),
    "multimodal_joint": ("text", "vision", "image", "ocr", "ocr+vision"),
    "image_related": ("ocr", "vision", "ocr+vision", "image", "text"),
    "text_related": ("text", "ocr", "ocr+vision", "vision", "image"),
}
EXTENSION_BONUS = {
    "none": {".txt": 0.02, ".md": 0.02, ".pdf": 0.02, ".docx": 0.02, ".epub": 0.02},
    "timeseries_related": {".json": 0.07, ".txt": 0.02, ".md": 0.02, ".pdf": 0.01, ".docx": 0.01, ".epub": 0.01},
    "multimodal_joint": {".txt": 0.02, ".md": 0.02, ".pdf": 0.02, ".docx": 0.02, ".epub": 0.02, ".png": 0.02, ".jpg": 0.02, ".jpeg": 0.02, ".bmp": 0.02, ".webp": 0.02},
    "image_related": {".png": 0.05, ".jpg": 0.05, ".jpeg": 0.05, ".bmp": 0.05, ".webp": 0.05, ".pdf": 0.01, ".epub": -0.03, ".docx": -0.03},
    "text_related": {".txt": 0.02, ".md": 0.03, ".pdf": 0.03, ".docx": 0.03, ".epub": 0.03, ".png": -0.03, ".jpg": -0.03, ".jpeg": -0.03, ".bmp": -0.03, ".webp": -0.03},
}
REQUIRED = {"image_related": ("ocr", "vision", "ocr+vision", "image"), "multimodal_joint": ("text", "vision", "image", "ocr", "ocr+vision")}
PATH_HINTS = {"multimodal_joint": ("图片", "图像", "照片", "文档", "书籍", "内容"), "image_related": ("图片", "图像", "截图", "照片", "ocr", "图中", "画面")}

# gates and requirements of answers
CHECKLIST = ("哪些", "哪几", "分别", "同时", "以及", "角色", "原因", "措施", "步骤", "职责")
WHY = ("背景", "原因", "事件", "为什么", "影响")
OBSERVED = ("趋势", "上升", "下降", "波动", "峰值", "谷值", "时间范围")
EXPLAINED = ("背景", "原因", "事件", "由于", "导致", "文本证据", "冷空气")
ANOMALIES = ("异常", "峰值", "谷值", "拐点", "波动")
ANSWER_TIMES = ("当前", "最新", "现任", "截至", "哪一年", "哪年", "何时", "什么时候", "什么时间", "日期", "时间")
PAST_ROLES = ("曾任", "历任", "前任", "上一任", "原", "时任", "当时", "哪一任", "哪位曾")
CURRENT_ROLES = ("校长", "院长", "主任", "书记", "局长", "部长", "市长", "县长", "董事长", "总经理", "ceo", "负责人", "馆长")
UNFINISHED = ("多方合力共[。；;，,]?", "具体如下[:：]?[。；;，,]?", "主要有以下[:：]?[。；;，,]?", "包括以下[:：]?[。；;，,]?")

# arithmetic in questions
AVERAGE = ("平均",)
MULTIPLY = ("乘积", "相乘", "乘起来", "乘以")
DIVIDE = ("除以", "相除", "比值")
SUBTRACT = ("差值", "相减", "减去", "差")
