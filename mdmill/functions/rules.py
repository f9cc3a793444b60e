"""Rule tables of the material domain."""

# They must equal the rules that records were governed by so far.
SYNONYMS = {
    "机械密封": ["机封", "端面密封", "密封", "mechanical seal", "face seal", "seal"],
    "轴承": ["bearing", "滚动轴承", "ball bearing", "roller bearing"],
    "闸阀": ["阀门", "gate valve", "闸伐", "闸板阀"],
    "O型圈": ["o-ring", "o ring", "密封圈", "o型密封圈", "o圈"],
    "法兰": ["flange", "法兰盖", "盲板", "盲法兰", "盲板法兰"],
    "螺栓": ["螺柱", "stud bolt", "hex bolt", "bolt", "双头螺栓", "六角螺栓", "紧固件"],
    "润滑油": ["润滑脂", "液压油", "齿轮油", "柴油机油", "lubricant", "lubricating oil", "grease", "oil"],
    "滤芯": ["滤材", "过滤器", "filter", "filter element", "滤清器"],
    "压力变送器": ["变送器", "transmitter", "pressure transmitter", "差压变送器"],
    "防爆电机": ["电机", "motor", "ex motor", "explosion-proof motor"],
    "304": ["304ss", "304不锈钢", "cf8", "sus304"],
    "304L": ["304l", "304l不锈钢", "cf3"],
    "316L": ["316ss", "316l不锈钢", "316l", "sus316l"],
    "316": ["316ss", "sus316"],
    "2205": ["2205", "双相钢", "duplex"],
    "C276": ["c276", "哈氏合金", "hastelloy"],
    "铸钢": ["铸钢", "碳钢", "wcb", "cast steel", "carbon steel"],
    "氟橡胶": ["氟橡胶", "fkm", "viton", "氟胶"],
    "丁腈橡胶": ["丁腈", "丁腈橡胶", "nbr", "nitrile"],
    "硅橡胶": ["硅胶", "硅橡胶", "vmq", "silicone"],
    "全氟醚": ["全氟醚", "ffkm", "kalrez", "perfluoroelastomer"],
    "碳化硅": ["sic", "碳化硅", "silicon carbide"],
    "钛合金": ["钛", "钛合金", "ti", "titanium"],
    "铬钼钢": ["铬钼钢", "crmo"],
    "Q235": ["q235", "q235b"],
    "35CrMoA": ["35crmo", "35crmoa"],
    "1.6MPa": ["1.6mpa", "pn16", "16公斤", "16bar", "class150", "150lb", "150#"],
    "2.5MPa": ["2.5mpa", "pn25", "25公斤", "25bar", "class300", "300#"],
    "4.0MPa": ["4.0mpa", "pn40", "40公斤", "40bar", "class600", "600#"],
    "10MPa": ["10mpa", "pn100", "100公斤", "100bar"],
    "0.6MPa": ["0.6mpa", "6bar", "class150", "150lb"],
    "1.0MPa": ["1.0mpa", "10bar", "pn10"],
    "6.0MPa": ["6.0mpa", "60bar", "class600"],
    "25MPa": ["25mpa", "250bar", "250#"],
}
BRANDS = [
    "SKF", "FAG", "NSK", "NTN", "Koyo", "INA", "Timken", "罗斯蒙特", "Rosemount", "横河", "Yokogawa", "霍尼韦尔",
    "Honeywell", "E+H", "Endress+Hauser", "西门子", "Siemens", "ABB", "Festo", "SMC", "壳牌", "Shell", "美孚", "Mobil",
    "长城", "Great Wall", "昆仑", "Kunlun",
]
RAW_CATEGORIES = {"轴承": "轴承", "密封圈": "O型圈", "阀门": "闸阀", "电机": "防爆电机", "润滑油": "润滑油"}
CATEGORY_PATTERNS = [
    ("机械密封", "机封|密封|seal|端面密封|波纹管|集装"),
    ("深沟球轴承", "轴承|bearing|skf|fag|nsk|ntn|koyo"),
    ("闸阀", "闸阀|闸伐|gate valve|闸板"),
    ("O型圈", "o[ -]?ring|o\\s*型圈|密封圈|oring"),
    ("法兰", "法兰|flange|盲板"),
    ("压力变送器", "变送器|transmitter|rosemount|横河|霍尼韦尔|西门子|3051|eja"),
    ("防爆电机", "防爆电机|电机|ex motor|yb3|motor"),
    ("滤芯", "滤芯|filter|滤清器"),
    ("润滑油", "润滑油|液压油|齿轮油|柴油机油|锂基脂|lubricant|oil|grease"),
    ("螺栓", "螺栓|螺柱|bolt|stud"),
]
MODEL_PATTERNS = [
    "\\bcm0?4b[-–—]?0?\\d{2,3}\\b", "\\b6[23]\\d{2}[-]?\\d?[a-z0-9]*\\b", "\\bz9?4\\d[hwp][-]?\\d{1,3}[cp]?",
    "\\byb3[-–—]?\\d{3}[mls][-]?\\d", "\\beja\\d{3}[ae]?\\b", "\\b3051[a-z0-9]*\\b", "\\bpmp\\d{2}\\b", "\\bhp\\d{4}[a-z]*\\d*\\b",
    "\\bpaf[-–—]?\\d[-–—]?0\\.\\d{2}\\b", "\\bac[-–—]?\\d{3}\\b", "\\bjcg[-–—]?\\d{3}\\b", "\\blx[-–—]?\\d{3}\\b", "\\bsx[-–—]?\\d{3}\\b",
    "\\bcng[-–—]?\\d{2}\\b", "\\bm1[6-9]|m[2-3][0-9]?\\b", "\\bp320\\b", "\\bl-hm46\\b",
]
INCHES = {"3": "80", "4": "100", "6": "150", "8": "200", "10": "250", "12": "300"}
PRESSURE_PATTERNS = [
    ("0.6MPa", "0\\.6mpa|6bar|class150|150lb|150#"),
    ("1.0MPa", "1\\.0mpa|10bar"),
    ("1.6MPa", "1\\.6mpa|pn16|16公斤|16bar|class150|150lb|150#"),
    ("2.5MPa", "2\\.5mpa|pn25|25公斤|25bar|class300|300#"),
    ("4.0MPa", "4\\.0mpa|pn40|40公斤|40bar|class600"),
    ("6.0MPa", "6\\.0mpa|60bar|class600"),
    ("10MPa", "10mpa|pn100|100公斤|100bar"),
    ("25MPa", "25mpa|250bar"),
]
MATERIAL_PATTERNS = [
    ("全氟醚", "全氟醚|ffkm|kalrez"), ("35CrMoA", "35crmo"), ("丁腈橡胶", "丁腈|nbr"), ("硅橡胶", "硅橡胶|vmq|silicone"),
    ("氟橡胶", "氟橡胶|fkm|viton|氟胶"), ("碳化硅", "碳化硅|sic"), ("铬钼钢", "铬钼钢|crmo"),
    ("哈氏合金", "哈氏合金|c276|hastelloy"), ("钛合金", "钛合金|钛材|titanium|(?<![a-z0-9])ti(?![a-z0-9])"),
    ("316L", "316l|sus316l"), ("316", "(316|316ss|sus316)(?!l)"), ("304L", "304l|cf3"), ("304", "(304|304ss|cf8|sus304)(?!l)"),
    ("2205", "2205|双相钢|duplex"), ("Q235", "q235|q235b"), ("铸钢", "铸钢|碳钢|wcb"),
]
PLANT_ALIASES = {
    "集团": "GROUP", "集团总部": "GROUP", "总部": "GROUP", "group": "GROUP", "hq": "GROUP",
    "上海": "SHANGHAI", "上海厂": "SHANGHAI", "上海工厂": "SHANGHAI", "shanghai": "SHANGHAI", "sh": "SHANGHAI",
    "北京": "BEIJING", "北京厂": "BEIJING", "北京工厂": "BEIJING", "beijing": "BEIJING", "bj": "BEIJING",
}
#: source system -> (connector, source table)
CONNECTORS = {
    "SAP": ("sap-odata", "MARA"), "ERP": ("erp-rest", "MATERIAL_MASTER"), "EAM": ("eam-rest", "EAM_MATERIAL"),
    "MES": ("mes-rest", "MES_MATERIAL"), "WMS": ("wms-rest", "WMS_ITEM"), "采购": ("procurement-rest", "PURCHASE_ITEM"),
    "CSV": ("file-import", "CSV_ROW"),
}
CONNECTOR_NAMES = {
    "SAP": "SAP ERP OData", "ERP": "ERP 主数据接口", "EAM": "EAM 设备物资接口", "MES": "MES 物料接口", "WMS": "WMS 库存物料接口", "采购": "采购平台物料接口", "CSV": "文件接入适配器",
}
PROVENANCE_HEADERS = {
    "id": ("源记录id", "源记录编号", "原记录id", "业务主键", "source_record_id", "record_id", "object_id"),
    "table": ("源表", "来源表", "业务对象", "source_table", "table_name", "object_type"),
    "url": ("源记录链接", "来源链接", "source_url", "record_url", "deep_link"),
}
REQUIRED = [
    ("material_code", "物料编码", "HIGH"), ("material_name", "物料名称", "HIGH"), ("description", "物料描述", "MEDIUM"),
    ("category", "物料分类", "MEDIUM"), ("unit", "计量单位", "MEDIUM"), ("system_source", "来源系统", "HIGH"),
]
DUE_DAYS = {"HIGH": 2, "MEDIUM": 5}
RETENTION_DAYS = {"PUBLIC": 365, "INTERNAL": 730, "CONFIDENTIAL": 1095, "RESTRICTED": 1825}
OTHER = "其他"
EDGE, SEMANTIC_EDGE, SAME_BRAND, SAME_MATERIAL = 0.55, 0.85, 0.15, 0.10
SHOWN_INCHES = {"1": "25", "2": "50", "3": "80", "4": "100", "5": "125", "6": "150", "8": "200", "10": "250", "12": "300"}
CODE_PREFIXES = {
    "机械密封": "MDM-48", "轴承": "MDM-51", "深沟球轴承": "MDM-51", "O型圈": "MDM-51", "滤芯": "MDM-51", "润滑油": "MDM-51", "螺栓": "MDM-51",
    "法兰": "MDM-52", "闸阀": "MDM-53", "压力变送器": "MDM-58", "防爆电机": "MDM-58",
}
TARGET_SYSTEMS = {
    "SAP": ("sap",), "ERP": ("erp",), "EAM": ("eam", "设备系统", "资产系统"), "MES": ("mes", "制造系统", "生产系统"),
    "WMS": ("wms", "仓储系统", "库存系统", "仓库系统"), "PROCUREMENT": ("采购",),
}
ALL_SYSTEMS = ("全部系统", "所有系统", "all systems")
INCREMENTAL_WORDS = ("增量", "新增", "刚批准", "最新")
DELIVERY_VERBS = ("分发", "发往", "发送", "同步", "下发", "推送", "发到")
DELIVERY_PLACES = ("系统", "工厂", "上海厂", "北京厂")
GOVERN_WORDS = ("治理", "归并", "查重", "闭环", "质量评估", "审核", "编排", "处理批次")
#: weights of rule, lexical and vector scores; least score and lead of an automatic answer
RETRIEVAL_WEIGHTS, AUTO_SCORE, AUTO_MARGIN = (0.45, 0.30, 0.25), 0.68, 0.08
SEARCH_WEIGHTS = {"model": 0.50, "brand": 0.25, "dn": 0.20, "pressure": 0.20, "material": 0.20, "category": 0.30}
RANK_WEIGHTS = {"brand": 0.20, "model": 0.35, "name": 0.30}
FIELD_LABELS = {
    "brand": ("品牌", "brand"), "model": ("型号", "model"), "name": ("备品备件名称", "物料名称", "备件名称", "零件名称", "名称", "name"),
}
LABEL_ENDS = "品牌|型号|备品备件名称|物料名称|备件名称|零件名称|发往|同步到|分发到"
KEYWORD_BREAK = r"[\s、,，/；;|]+"
#: Categories of the standard that are searched without a tree: id, category, code prefix, title, words.
STANDARDS = [
    ("SYT-MDM-48-SEAL", "机械密封", "MDM-48", "泵用机械密封适配分类", "机械密封 机封 端面密封 mechanical seal face seal 波纹管 集装式"),
    ("SYT-MDM-51-BEARING", "深沟球轴承", "MDM-51", "滚动轴承适配分类", "轴承 滚动轴承 深沟球轴承 bearing SKF FAG NSK NTN"),
    ("SYT-MDM-53-GATE", "闸阀", "MDM-53", "工业闸阀适配分类", "闸阀 闸板阀 gate valve Z41 Z941 法兰连接"),
    ("SYT-MDM-51-ORING", "O型圈", "MDM-51", "O型密封圈适配分类", "O型圈 O-Ring 密封圈 FKM NBR 氟橡胶 丁腈橡胶"),
    ("SYT-MDM-52-FLANGE", "法兰", "MDM-52", "管法兰适配分类", "法兰 flange 对焊法兰 平焊法兰 盲法兰 WN PL BL RF"),
    ("SYT-MDM-51-BOLT", "螺栓", "MDM-51", "紧固件适配分类", "螺栓 螺柱 双头螺栓 bolt stud bolt 紧固件"),
    ("SYT-MDM-51-OIL", "润滑油", "MDM-51", "工业润滑介质适配分类", "润滑油 润滑脂 液压油 齿轮油 柴油机油 lubricant grease oil"),
    ("SYT-MDM-51-FILTER", "滤芯", "MDM-51", "工业过滤元件适配分类", "滤芯 过滤器 滤材 filter element 液压油滤芯 空气滤芯"),
    ("SYT-MDM-58-PT", "压力变送器", "MDM-58", "压力测量仪表适配分类", "压力变送器 transmitter pressure transmitter 3051 EJA STG 4-20mA"),
    ("SYT-MDM-58-MOTOR", "防爆电机", "MDM-58", "防爆驱动设备适配分类", "防爆电机 隔爆电机 explosion-proof motor ex motor YB3 Exd"),
]
EXCLUDE_WORDS = "不要|排除|不含|非|without|exclude"
LEADER_EDGE = 0.85
# End of fixed values.
