"""Queries of titles and matching, over listings made from the parts.

Titles are made from a table of known products; what the oracles expect comes from that table and from
the parts' keys, not from any pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reading
from ..functions import text as tx
from ..functions import titles as tt
from ..operators import matching, tables
from .registry import dealt, query, sql_values, t

#: Titles, and what they say: category, model in lower case, attributes.
KNOWN: tuple[tuple[str, str | None, str | None, str], ...] = (
    ("Placa De Vídeo GPU 12GB Dual Asus GeForce RTX 5070 OC Edition", "gpu", "geforce rtx 5070", "edition=dual oc edition|gpu_model=rtx5070|vram=12gb"),
    ("MSI GeForce RTX 5070 Shadow 3X OC 12GB GDDR7", "gpu", "geforce rtx 5070", "edition=shadow 3x oc|gpu_model=rtx5070|memory_type=gddr7|vram=12gb"),
    ("Sapphire Pulse Radeon RX 9070 XT 16GB GDDR6", "gpu", "radeon rx 9070 xt", "edition=pulse|gpu_model=rx9070xt|memory_type=gddr6|vram=16gb"),
    ("ASUS TUF Gaming B650M-Plus WiFi AM5 DDR5", "motherboard", "tuf gaming b650m-plus", "board=b650mplus|memory_type=ddr5|socket=am5|wifi=wifi"),
    ("AMD Ryzen 7 7800X3D", "cpu", "ryzen 7 7800x3d", "processor=ryzen7-7800x3d"),
    ("Processador Intel Core i7-14700K LGA 1700", "cpu", "core i7-14700k", "processor=i7-14700k|socket=lga1700"),
    ("Apple iPhone 16 Pro 256GB Black", "smartphone", "iphone 16 pro", "color=black|phone=iphone16pro|storage=256"),
    ("Samsung Galaxy S25 Ultra 512GB Titânio Preto Desbloqueado", "smartphone", "galaxy s25 ultra", "color=black|network_lock=unlocked|phone=galaxys25ultra|storage=512"),
    ("Samsung 990 PRO 2TB NVMe M.2 PCIe 4.0", "ssd", "990 pro", "form_factor=m.2|interface=nvme|pcie_generation=4.0|series=990pro|storage=2048"),
    ("PlayStation 5 Slim Digital 1TB", "console", "playstation 5", "console=playstation 5|console_edition=digital|storage=1024"),
    ("Kingston Fury Beast DDR5 32GB 6000MHz CL36", "ram", "fury beast", "cas_latency=36|frequency=6000|memory_type=ddr5|ram=32"),
    ("ASUS ROG Strix G16 i9-14900HX RTX 4070 16GB 1TB", "notebook", "rog strix g16", "gpu_model=rtx4070|processor=i9-14900hx|ram=16|storage=1024"),
    ("Carregador GaN 65W USB-C", "charger", None, "small_wattage=65"),
    ("Water Cooler MSI MAG Coreliquid A12, ARGB, 360mm", "cooler", "mag coreliquid a12", "cooler_type=liquid|radiator_size=360|rgb=argb"),
    ("Water cooler msi 360mm amd/intel mag coreliquid a12 360 argb preto", "cooler", "mag coreliquid a12", "cooler_type=liquid|radiator_size=360|rgb=argb"),
    ("Fonte Corsair RM850x 850W 80 Plus Gold Full Modular", "psu", "rm850x", "efficiency=80 plus gold|modularity=full|wattage=850 w"),
    ('Monitor LG UltraGear 27GP850 27" QHD 165Hz IPS', "monitor", "ultragear 27gp850", "panel=ips|refresh_rate=165|resolution=2560x1440|screen_size=27"),
    ('Smart TV LG C4 55" 4K OLED 120Hz', "tv", "c4", "panel=oled|refresh_rate=120|resolution=3840x2160|screen_size=55"),
    ("iPad Air 256GB WiFi Azul", "tablet", None, "color=blue|storage=256|tablet=ipadair|wifi=wifi"),
    ("Roteador TP-Link Archer AX73 WiFi 6", "router", "archer ax73", "wifi=wifi 6"),
    ("Teclado Redragon Kumara Switch Brown ABNT2 RGB", "keyboard", "kumara switch brown abnt2", "layout=abnt2|rgb=rgb|switch_type=brown"),
    ("Mouse Logitech Superlight 25600 DPI sem fio branco", "mouse", "superlight", "color=white|connectivity=wireless|dpi=25600"),
    ("Headset HyperX Cloud III com fio preto", "headset", "cloud iii", "color=black|connectivity=wired"),
    ("DualSense Sony CFI-ZCT1 vermelho wireless", "gamepad", "cfi-zct1", "color=red|connectivity=wireless"),
    ("Placa de rede PCIe TP-Link Archer TX55E WiFi 6E bluetooth", "wifi_adapter", "archer tx55e", "interface=bluetooth|wifi=wifi 6e"),
    ("Gigabit Switch TP-Link TL-SG108PE 8 portas PoE", "network_switch", "tl-sg108pe", "poe=poe|port_count=8"),
    ("Ventoinha Corsair SP120 120mm 3 fans RGB", "fan", "sp120", "fan_count=3|fan_size=120|rgb=rgb"),
    ("Impressora Epson EcoTank L3250 WiFi", "printer", "ecotank l3250", "print_technology=ink|wifi=wifi"),
    ("Webcam Logitech C920 Full HD 30fps", "webcam", "c920", "fps=30|resolution=1920x1080"),
    ("Gabinete NZXT H5 ATX branco", "case", "h5 atx", "color=white|form_factor=atx"),
    ("Soundbar JBL Bar 5.1 canais 300W", "speaker", "bar", "channels=5.1|small_wattage=300"),
    ("Projetor Epson EF-12 3600 lumens Full HD", "projector", "ef-12", "brightness=3600|resolution=1920x1080"),
    ("Lente Canon RF 50mm f/1.8", "lens", "rf", "focal_length=50|mount=rf"),
    ("Cartao de memoria microSD 256GB", "memory_card", None, "storage=256"),
    ("NAS Synology 4 baias", "nas", None, "bay_count=4"),
    ("Nobreak 1500VA 900W", "ups", None, "small_wattage=900|va=1500"),
    ("Cabo HDMI 2.1 3m", "cable", None, "length=3|standard=2.1"),
    ("Cadeira gamer preta", "chair", None, "color=black"),
    ("Standing desk 140 cm", "desk", None, "width=140"),
    ("VESA mount 75x75 articulado", "monitor_mount", None, "vesa=75x75"),
    ("Apple Watch 45mm cellular midnight", "smartwatch", "watch", "case_size=45|cellular=cellular|color=midnight"),
    ("Camera Canon EF mirrorless", "camera", "ef mirrorless", "mount=ef"),
    ("Something without a kind", None, None, ""),
)
_N = len(KNOWN)


def listings(spark, sf_dir):
    """A known product's title for each part, in three ways of writing: as it is, in capitals, with wide spaces."""
    known = F.broadcast(spark.createDataFrame([(i, k[0]) for i, k in enumerate(KNOWN)], "v int, title string"))
    p = dealt(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % _N).cast("int").alias("v"), (F.floor(F.col("p_partkey") / _N) % 3).alias("way"))
    way = F.when(F.col("way") == 1, F.upper("title")).when(F.col("way") == 2, F.concat(F.lit(" "), F.replace("title", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.col("title"))
    return p.join(known, "v").select("p_partkey", F.regexp_replace(way, "  +", F.lit(" ")).alias("title"))


@query(f"""SELECT p_partkey, category, model, attributes FROM part JOIN (VALUES {sql_values([(i, *k[1:]) for i, k in enumerate(KNOWN)])}) k(v, category, model, attributes) ON k.v = p_partkey % {_N}""")
def title_identity(spark, sf_dir):
    """Category, model and attributes of titles of all categories."""
    d = listings(spark, sf_dir).withColumn("t", tx.fold(F.col("title")))
    d = d.withColumn("said", reading.read(F.col("t")))
    stated = F.coalesce(tx.variant_key(F.col("said.attributes")), F.lit(""))
    return d.select("p_partkey", "said.category", "said.model", stated.alias("attributes"))


_CONDITION = (("Renewed Premium", "renewed", "premium"), ("recondicionado", "refurbished", None), ("Open-Box", "open_box", None), ("usada", "used", None), ("novo", "new", None), ("", "unknown", None), ("renovada", "renewed", None))
_LOCK = (("Fully Unlocked", "unlocked", None), ("bloqueado", "locked", None), ("AT&T", "locked", "at&t"), ("T-Mobile", "locked", "t-mobile"), ("", None, None))


@query(f"""SELECT p_partkey, code, grade, lock, carrier FROM part JOIN (VALUES {sql_values([(i, c[1], c[2]) for i, c in enumerate(_CONDITION)])}) c(v, code, grade) ON c.v = p_partkey % 7 JOIN (VALUES {sql_values([(i, c[1], c[2]) for i, c in enumerate(_LOCK)])}) l(w, lock, carrier) ON l.w = p_partkey % 5""")
def offer_conditions(spark, sf_dir):
    """Condition, its grade, network lock and carrier."""
    pick = lambda table, n: F.element_at(F.array(*(F.lit(x[0]) for x in table)), (F.col("p_partkey") % n + 1).cast("int"))
    d = dealt(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lit("Telefone"), pick(_CONDITION, 7), F.lit("128GB"), pick(_LOCK, 5)).alias("title"))
    d, folded = d.withColumn("t", tx.fold(F.col("title"))).withColumn("said", reading.read(F.col("t"))), F.col("t")
    return d.select("p_partkey", tt.condition(folded)["code"].alias("code"), tt.condition(folded)["grade"].alias("grade"), "said.lock", "said.carrier")


_MORE = dict(brand=None, gtin=None, variant=None, store="other", pid=None, price=100)
_G = "7891991010863"


def _side(title: str, **more) -> tuple:
    m = _MORE | more
    return (title, m["brand"], m["gtin"], m["variant"], m["store"], m["pid"], m["price"])


#: Pairs of a reference and a candidate, and what becomes of them: decision, confidence, reason.
PAIRS: tuple[tuple[tuple, tuple, str, float, str], ...] = (
    (_side('Monitor LG UltraGear 27GP850 27" QHD'), _side('Monitor LG UltraGear 27GP950 27" QHD'), "reject", 0, "monitor_model_code_conflict"),
    (_side("iPhone 16 Apple", variant="color: black; storage: 256 GB"), _side("Apple iPhone 16", variant="cor: Branco; armazenamento: 256GB"), "reject", 0, "variant_mismatch"),
    (_side("iPhone 16 Apple", variant="storage: 256 GB"), _side("Apple iPhone 16", variant="capacidade: 512GB"), "reject", 0, "variant_mismatch"),
    (_side("iPhone 15 128GB unlocked"), _side("iPhone 15 128GB Verizon"), "reject", 0, "variant_mismatch"),
    (_side("Placa de video MSI GeForce RTX 5070"), _side("Placa de video MSI GeForce RTX 5070 Ti"), "reject", 0, "critical_conflict"),
    (_side("Samsung 990 PRO 2TB NVMe"), _side("Samsung 990 EVO Plus 2TB NVMe"), "reject", 0, "critical_conflict"),
    (_side("Samsung 990 PRO 2TB NVMe"), _side("Samsung 990 PRO 1TB NVMe"), "reject", 0, "critical_conflict"),
    (_side("AMD Ryzen 7 7800X3D"), _side("AMD Ryzen 7 7700X"), "reject", 0, "critical_conflict"),
    (_side("PlayStation 5 Slim Digital"), _side("PlayStation 5 Slim Blu-ray"), "reject", 0, "critical_conflict"),
    (_side("Fonte Corsair RM850x 850W 80 Plus Gold"), _side("Fonte Corsair RM750x 750W 80 Plus Gold"), "reject", 0, "critical_conflict"),
    (_side("Kingston Fury Beast DDR5 32GB"), _side("Kingston Fury Beast DDR4 32GB"), "reject", 0, "critical_conflict"),
    (_side("Apple iPhone 16 Pro"), _side("Capa Apple iPhone 16 Pro"), "reject", 0, "accessory_reject"),
    (_side("PlayStation 5 Slim"), _side("PlayStation 5 Slim com 2 jogos"), "reject", 0, "bundle_reject"),
    (_side("Placa de video MSI GeForce RTX 5060"), _side("Notebook MSI RTX 5060"), "reject", 0, "form_factor_reject"),
    (_side("Apple iPhone 15 128GB"), _side("Apple iPhone 15 128GB seminovo"), "reject", 0, "condition_reject"),
    (_side('Monitor LG UltraGear 27GP850 27"'), _side('LG monitor 27GP850 27" QHD IPS'), "auto_match", 0.99, "monitor_model_code_exact"),
    (_side('Monitor LG UltraGear 27GP850 27"'), _side('Monitor 27GP850 27"', brand="Zed"), "review", 0.85, "monitor_model_code_brand_conflict"),
    (_side("Um produto", store="s1", pid="77"), _side("Outro nome", store="s1", pid="77"), "auto_match", 1, "same_store_product_id"),
    (_side("Um produto", gtin=_G), _side("Outro nome", gtin=_G), "auto_match", 0.99, "gtin_exact"),
    (_side("Um produto", gtin=_G, brand="Acme"), _side("Outro nome", gtin=_G, brand="Zed"), "review", 0.85, "gtin_brand_conflict"),
    (_side("iPhone 15 128GB", gtin=_G), _side("iPhone 15 128GB Verizon", gtin=_G), "review", 0.88, "carrier_variant_uncertain"),
    (_side("Samsung SSD MZ-V9P2T0BW"), _side("Samsung interno MZV9P2T0BW"), "auto_match", 0.98, "mpn_exact"),
    (_side("SSD MZ-V9P2T0BW", brand="Acme"), _side("SSD MZ-V9P2T0BW", brand="Zed"), "review", 0.85, "mpn_brand_conflict"),
    (_side("Apple iPhone A3519"), _side("Apple telefone A3519"), "auto_match", 0.98, "model_number_exact"),
    (_side("Apple iPhone A3519", variant="color: nebula"), _side("Apple telefone A3519", variant="color: aurora"), "review", 0.85, "variant_semantic_uncertain"),
    (_side("Telefone A3519", brand="Acme"), _side("Telefone A3519", brand="Zed"), "review", 0.85, "model_number_brand_conflict"),
    (_side("AMD Ryzen 7 7800X3D"), _side("Processador Ryzen 7 7800X3D AM5 box"), "auto_match", 0.98, "processor_model_exact"),
    (_side("Processador Ryzen 7 7800X3D", brand="AMD"), _side("Processador Ryzen 7 7800X3D", brand="Zed"), "review", 0.85, "processor_brand_conflict"),
    (_side("Kingston Fury Beast DDR5 32GB"), _side("Corsair Vengeance DDR5 32GB"), "reject", 0, "brand_mismatch"),
    (_side("SSD Samsung 990 PRO 2TB NVMe"), _side("Samsung SSD 990 Pro NVMe 2TB"), "auto_match", 0.92, "brand_model_exact"),
    (_side("SSD Samsung 990 PRO 2TB NVMe"), _side("Samsung SSD 990 Pro NVMe 2TB", price=500), "review", 0.88, "price_deviation"),
    (_side("Apple iPhone 15 128GB"), _side("Apple iPhone 15 128GB Verizon"), "review", 0.88, "carrier_variant_uncertain"),
    (_side("Apple iPhone 15 128GB", variant="color: nebula"), _side("Apple iPhone 15 128GB", variant="color: aurora"), "review", 0.89, "variant_semantic_uncertain"),
    (_side("Apple iPhone 15 128GB", variant="color: azul"), _side("Apple iPhone 15 128GB", variant="color: Blue"), "auto_match", 0.92, "brand_model_exact"),
    (_side("Apple iPhone 15 128GB recondicionado"), _side("Apple iPhone 15 128GB Renewed"), "auto_match", 0.92, "brand_model_exact"),
    (_side("Mesa alta de madeira clara"), _side("Mesa alta de vidro"), "reject", 0.1750, "score"),
    (_side("Luva de couro", variant="color: nebula"), _side("Luva grande", variant="color: aurora"), "review", 0.75, "variant_semantic_uncertain"),
    (_side('Monitor Dell 27" QHD 165Hz IPS'), _side('Monitor Dell 27" QHD 165Hz IPS slim'), "review", 0.89, "score"),
)
_SIDE = "title string, brand string, gtin string, variant string, store string, product_id string, price int"


def _pairs_of(spark, side: int):
    rows = [(i, *p[side]) for i, p in enumerate(PAIRS)]
    return F.broadcast(spark.createDataFrame(rows, "v int, " + _SIDE)).withColumn("price", F.col("price").cast("decimal(18,4)")).withColumn("currency", F.lit("BRL"))


@query(f"""SELECT p_partkey, decision, CAST(confidence AS DECIMAL(5,4)) AS confidence, reason FROM part JOIN (VALUES {sql_values([(i, p[2], p[3], p[4]) for i, p in enumerate(PAIRS)])}) k(v, decision, confidence, reason) ON k.v = p_partkey % {len(PAIRS)}""")
def match_decisions(spark, sf_dir):
    """The ordered decision, with pairs for every rule."""
    p = dealt(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(PAIRS)).cast("int").alias("v"))
    fields = [*matching.IDENTITY, "store", "product_id", "price", "currency"]
    side = lambda i, name: matching.identity(p.join(_pairs_of(spark, i), "v"), "title", "brand", "gtin", variant="variant").select("p_partkey", F.struct(*fields).alias(name))
    return matching.decide(side(0, "a").join(side(1, "b"), "p_partkey")).select("p_partkey", "decision", "confidence", "reason")


@query("""WITH x AS (SELECT l.p_partkey AS l, r.p_partkey AS r, l.p_partkey % 8 AS i, r.p_partkey % 8 AS j FROM part l JOIN part r ON r.p_partkey // 8 = l.p_partkey // 8),
d AS (SELECT l, r, CASE WHEN (i=2) <> (j=2) THEN 'critical_conflict' WHEN j=4 AND i<>4 THEN 'accessory_reject' WHEN j=7 AND i<>7 THEN 'bundle_reject' WHEN j=3 AND i<>3 THEN 'condition_reject' WHEN i=j OR (i IN (0,5) AND j IN (0,5)) THEN 'same_store_product_id' WHEN (i=6) <> (j=6) THEN 'mpn_brand_conflict' ELSE 'mpn_exact' END AS reason FROM x)
SELECT l, r, CASE WHEN reason IN ('same_store_product_id', 'mpn_exact') THEN 'auto_match' WHEN reason = 'mpn_brand_conflict' THEN 'review' ELSE 'reject' END AS decision, CAST(CASE reason WHEN 'same_store_product_id' THEN 1 WHEN 'mpn_exact' THEN 0.98 WHEN 'mpn_brand_conflict' THEN 0.85 ELSE 0 END AS DECIMAL(5,4)) AS confidence, reason FROM d""")
def product_matching(spark, sf_dir):
    """All listings matched to all listings: each eight parts are listings of one product in eight ways, blocked by
    what their titles say."""
    key, group, place = F.col("p_partkey"), F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    code = F.concat(F.lit("MZ-V"), F.lpad(group.cast("string"), 7, "0"))
    name = F.concat_ws(" ", F.lit("SSD"), F.concat(F.when(place == 6, "Zed").otherwise("Acme"), group.cast("string")), F.lit("NVMe 990 PRO"), F.when(place == 2, "2TB").otherwise("1TB"), code)
    title = F.when(place == 3, F.concat(name, F.lit(" usado"))).when(place == 4, F.concat(F.lit("Capa para "), name)).when(place == 7, F.concat(name, F.lit(" bundle"))).otherwise(name)
    brand = F.concat(F.when(place == 6, "Zed ").otherwise("Acme "), group.cast("string"))
    store = F.when(place.isin(0, 5), "first").otherwise(F.concat(F.lit("s"), place.cast("string")))
    product = F.when(place.isin(0, 5), group).otherwise(key).cast("string")
    d = dealt(spark, sf_dir, "part").select(key.alias("id"), title.alias("title"), brand.alias("brand"), F.lit(None).cast("string").alias("gtin"), F.col("p_retailprice").cast("decimal(18,4)").alias("price"), F.lit("USD").alias("currency"), store.alias("store"), product.alias("product_id"))
    return matching.match(d, d).select("l", "r", "decision", "confidence", "reason")


@query("""SELECT o, s, c FROM (SELECT p_partkey // 8 AS o, 's' || (p_partkey % 3) AS s, p_partkey AS c, row_number() OVER (PARTITION BY p_partkey // 8, p_partkey % 3 ORDER BY CASE WHEN stop IS NULL OR p_partkey <= stop THEN 0 ELSE 1 END, conf DESC, p_partkey) rn FROM (SELECT *, (p_partkey * 7 % 10) AS conf, min(CASE WHEN p_partkey * 7 % 10 >= 8 THEN p_partkey END) OVER (PARTITION BY p_partkey // 8, p_partkey % 3) AS stop FROM part)) WHERE rn = 1""")
def best_hit_per_store(spark, sf_dir):
    key = F.col("p_partkey")
    conf = (key * 7 % 10).cast("int")
    d = t(spark, sf_dir, "part").select(F.floor(key / 8).cast("long").alias("l"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("store"), key.alias("r"), conf.alias("confidence"), F.when(conf >= 8, "auto_match").otherwise("review").alias("decision"))
    return matching.best_per_store(d).select(F.col("l").alias("o"), F.col("store").alias("s"), F.col("r").alias("c"))


@query("""WITH x AS (SELECT p_partkey // 6 AS l, CASE WHEN p_partkey % 6 < 3 THEN 'auto_match' ELSE 'review' END AS decision, CASE WHEN p_partkey % 6 = 0 THEN 'a' WHEN p_partkey % 6 = 1 AND p_partkey // 6 % 2 = 0 THEN 'a' WHEN p_partkey % 6 = 1 THEN 'b' WHEN p_partkey % 6 > 2 THEN 'c' END AS gtin FROM part)
SELECT l, min(gtin) AS gtin FROM x WHERE decision = 'auto_match' AND gtin IS NOT NULL GROUP BY l HAVING count(DISTINCT gtin) = 1""")
def gtin_learning(spark, sf_dir):
    key = F.col("p_partkey")
    group, place = F.floor(key / 6).cast("long"), key % 6
    gtin = F.when(place == 0, "a").when((place == 1) & (group % 2 == 0), "a").when(place == 1, "b").when(place > 2, "c")
    d = t(spark, sf_dir, "part").select(group.alias("l"), F.when(place < 3, "auto_match").otherwise("review").alias("decision"), gtin.alias("gtin"))
    return matching.learned_gtin(d)


_VARIANTS = (
    ("Cor: Preto; Armazenamento: 256 GB", "color=preto|storage=256gb"),
    ("tamanho: 512GB; tamanho: 128GB", "storage=512gb"),
    ("size: 42; colour: Azul; colour: red", "color=azul|size=42"),
    ("memoria ram: 4; ram: 16 GB", "ram=16gb"),
    ("carrier lock: Desbloqueado; voltage: 220", "network_lock=unlocked"),
    ("no pairs here", ""),
)


@query(f"""SELECT p_partkey, attributes FROM part JOIN (VALUES {sql_values([(i, v[1]) for i, v in enumerate(_VARIANTS)])}) v(v, attributes) ON v.v = p_partkey % {len(_VARIANTS)}""")
def variant_parsing(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(v[0]) for v in _VARIANTS)), (F.col("p_partkey") % len(_VARIANTS) + 1).cast("int"))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.coalesce(tx.variant_key(tt.parse_variant(text)), F.lit("")).alias("attributes"))


_EQUALS = (("color", "Preto", "black", True, False), ("color", "Titânio", "Titanium Black", True, False), ("color", "Laranja cósmico", "Cosmic Orange", True, False), ("color", "Laranja", "cosmic orange", True, False), ("color", "azul", "vermelho", False, False), ("color", "nebula", "blue", False, True), ("storage", "1 TB", "1tb", True, False), ("storage", "256GB", "512GB", False, False), ("ram", "16g", "16 GB", True, False), ("screen_size", "27 in", '27"', True, False), ("resolution", "2560 x 1440", "QHD 2560x1440", True, False), ("edition", "Shadow 3X OC", "shadow-3x-oc", True, False), ("network_lock", "Desbloqueado", "unlocked", True, False))


@query(f"""SELECT p_partkey, equal = 'y' AS equal, uncertain = 'y' AS uncertain FROM part JOIN (VALUES {sql_values([(i, "y" if e[3] else "n", "y" if e[4] else "n") for i, e in enumerate(_EQUALS)])}) v(v, equal, uncertain) ON v.v = p_partkey % {len(_EQUALS)}""")
def variant_comparison(spark, sf_dir):
    known = F.broadcast(spark.createDataFrame([(i, *e[:3]) for i, e in enumerate(_EQUALS)], "v int, k string, a string, b string"))
    d = dealt(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_EQUALS)).cast("int").alias("v")).join(known, "v")
    d = d.withColumns({c: tt.variant_value(F.col("k"), F.col(c)) for c in ("a", "b")})
    args = (F.col("k"), F.col("a"), F.col("b"))
    return d.select("p_partkey", tt.canonical_equal(*args).alias("equal"), tt.canonical_uncertain(*args).alias("uncertain"))


_NORMAL = (("Placa de Vídeo RTX 5070 12 GB OFERTA", "rtx 5070 12gb"), ("Fone sem fio Preto original", "fone wireless black"), ("ASUS B650M-E WiFi", "asus b650me wifi"), ("iPhone 15 128 GB recondicionado", "iphone 15 128gb refurbished"), ("Galaxy desbloqueado azul", "galaxy unlocked blue"), ("Caixa aberta: Kindle", "openbox kindle"))


@query(f"""SELECT p_partkey, normal, stripped FROM part JOIN (VALUES {sql_values([(i, n[1], n[1].replace(" refurbished", "")) for i, n in enumerate(_NORMAL)])}) v(v, normal, stripped) ON v.v = p_partkey % {len(_NORMAL)}""")
def normalized_titles(spark, sf_dir):
    title = F.element_at(F.array(*(F.lit(n[0]) for n in _NORMAL)), (F.col("p_partkey") % len(_NORMAL) + 1).cast("int"))
    normal = tt.normalize_title(tx.fold(title))
    return dealt(spark, sf_dir, "part").select("p_partkey", normal.alias("normal"), tt.strip_condition(normal).alias("stripped"))


_CODES = (("ideapadslim3everydaylaptop", "ideapadslim3", False, False), ("abcdefnotebook", "abcdef", False, False), ("abcnotebook", "abcnotebook", False, False), ("mzv9p2t0bw", "mzv9p2t0bw", True, True), ("rtx5070intelcorelaptop", "rtx5070", False, True), ("a1b2c3d4e5", "a1b2c3d4e5", True, True), ("iphone16promax", "iphone16promax", False, True), ("short1", "short1", False, True))


@query(f"""SELECT p_partkey, compact, part_number = 'y' AS part_number, identifier = 'y' AS identifier FROM part JOIN (VALUES {sql_values([(i, c[1], "y" if c[2] else "n", "y") for i, c in enumerate(_CODES)])}) v(v, compact, part_number, identifier) ON v.v = p_partkey % {len(_CODES)}""")
def model_codes(spark, sf_dir):
    code = F.element_at(F.array(*(F.lit(c[0]) for c in _CODES)), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return dealt(spark, sf_dir, "part").select("p_partkey", tt.compact_code(code).alias("compact"), tt.looks_like_part_number(code).alias("part_number"), tt.identifier_only(code).alias("identifier"))


@query("""SELECT p_partkey, 'acme' || (p_partkey % 9) || ' mzv' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS second, 'acme' || (p_partkey % 9) || ' 990 pro 1tb black' AS third, 5 AS n FROM part""")
def search_ladder(spark, sf_dir):
    """Queries by which a product is looked up, the most telling first."""
    key = F.col("p_partkey")
    brand = F.concat(F.lit("acme"), (key % 9).cast("string"))
    title = F.concat(F.lit("SSD "), brand, F.lit(" 990 PRO 1TB usado MZ-V"), F.lpad(key.cast("string"), 7, "0"))
    q = tt.search_queries(F.lpad(key.cast("string"), 13, "0"), brand, F.lit("990 PRO"), tx.fold(title), F.lit("Black"), F.lit("1TB"), F.lit("ssd"))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.get(q, 1).alias("second"), F.get(q, 2).alias("third"), F.size(q).alias("n"))


@query("""SELECT p_partkey, 'category: ssd' || chr(10) || 'brand: ' || p_brand || chr(10) || 'variant_color: black' || chr(10) || 'variant_storage: ' || p_size || 'gb' AS structured, p_name || ' renewed' || chr(10) || 'category: ssd' || chr(10) || 'brand: ' || p_brand || chr(10) || 'variant_color: black' || chr(10) || 'variant_storage: ' || p_size || 'gb' AS hybrid FROM part""")
def embedding_texts(spark, sf_dir):
    variants = F.create_map(F.lit("storage"), F.concat(F.col("p_size").cast("string"), F.lit("gb")), F.lit("color"), F.lit(" black "))
    e = tt.embedding_texts(F.concat("p_name", F.lit(" renewed ")), F.lit("ssd"), F.col("p_brand"), F.lit(None).cast("string"), variants)
    return dealt(spark, sf_dir, "part").select("p_partkey", e["structured"].alias("structured"), e["hybrid"].alias("hybrid"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY CASE p_partkey % 5 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END, CASE WHEN p_partkey % 5 = 2 THEN 0 ELSE 1 END, p_partkey) AS position FROM part""")
def relevance_rank(spark, sf_dir):
    """Listings of a search by how well they fit: the whole code, words of the variant, words, the title's length."""
    titles = ("other thing", "ssd samsung 256gb black", "some long other title that has nothing in common", "samsung mzv9p2t0bw", "samsung ssd")
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("p_partkey") % 5 + 1).cast("int"))
    query_ = F.when(F.col("p_partkey") % 5 == 3, "MZ-V9P2T0BW").otherwise("samsung ssd 256GB black")
    d = dealt(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 5).alias("search"), matching.relevance(query_, title, F.lit("/p/1")).alias("score"))
    return matching.ranked(d, "search", F.col("score"), "p_partkey").select("p_partkey", F.col("position").cast("long").alias("position"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS hits FROM part""")
def identity_alignment(spark, sf_dir):
    """How much a title names of the wanted colour and storage."""
    titles = ("iphone preto 256gb", "iphone black", "iphone 256gb", "iphone branco")
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return dealt(spark, sf_dir, "part").select("p_partkey", matching.alignment(F.lit("Black"), F.lit("256 GB"), title).alias("hits"))


_PREFILTER = ((None, None), ("", None), ("Capa iPhone 15", "accessory_reject"), ("iPhone 15 bundle", "bundle_reject"), ("iPhone 15 usado", "condition_mismatch"), ("iPhone 14 Apple", "phone"), ("Samsung iPhone 15", "brand_mismatch"), ("iPhone 15 Apple 128GB", None))


@query(f"""SELECT p_partkey, reason FROM part JOIN (VALUES {sql_values([(i, p[1]) for i, p in enumerate(_PREFILTER)])}) v(v, reason) ON v.v = p_partkey % {len(_PREFILTER)}""")
def title_prefilter(spark, sf_dir):
    """Why a listing needn't be looked at by its title alone."""
    known = F.broadcast(spark.createDataFrame([(i, p[0]) for i, p in enumerate(_PREFILTER)], "v int, title string"))
    d = dealt(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_PREFILTER)).cast("int").alias("v")).join(known, "v")
    other = matching.identity(d, "title").select("p_partkey", F.struct(*matching.IDENTITY).alias("b"))
    mine = matching.identity(d.select("p_partkey", F.lit("Apple iPhone 15").alias("title")), "title").select("p_partkey", F.struct(*matching.IDENTITY).alias("a"))
    return mine.join(other, "p_partkey").select("p_partkey", matching.prefilter(F.col("a"), F.col("b")).alias("reason"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey AS k, 's' || s_suppkey AS store, CASE s_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 40 END AS loc, s_suppkey * 7 % 100 AS code FROM supplier),
c AS (SELECT k, loc, count(*) n, min(s_suppkey) f FROM s GROUP BY ALL), d AS (SELECT k, loc FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY loc = 10 DESC, n DESC, f) = 1),
w AS (SELECT s.*, CASE WHEN s.loc = d.loc AND code <= 55 THEN 1 WHEN s.loc = d.loc THEN 2 ELSE 3 END AS wave FROM s JOIN d USING (k))
SELECT k AS key, store, wave, row_number() OVER (PARTITION BY k, wave ORDER BY loc, code > 55, code, store) AS place FROM w""")
def store_waves(spark, sf_dir):
    key = F.col("s_suppkey")
    locale = F.when(key % 4 == 0, 10).when(key % 4 == 1, 20).otherwise(40)
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.concat(F.lit("s"), key.cast("string")).alias("store"), locale.alias("locale_rank"), (key * 7 % 100).cast("int").alias("code_rank"), key.alias("ord"))
    return matching.store_waves(s).select("key", "store", F.col("wave").cast("long").alias("wave"), F.col("place").cast("long").alias("place"))


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_acctbal > 0 AND s_nationkey IN (1, 2, 3)""")
def eligible_stores(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("store"), (F.col("s_suppkey") % 2 == 0).alias("implemented"), (F.col("s_acctbal") > 0).alias("match_enabled"))
    return matching.eligible(s, ("1", "2", "3")).select("s_suppkey")


@query("""WITH x AS (SELECT p_partkey, p_partkey // 5 AS product, CASE p_partkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 75 WHEN 2 THEN 40 WHEN 3 THEN 15 END AS pri, CASE WHEN p_partkey % 3 = 0 THEN 'removed' ELSE 'active' END AS status, p_partkey % 7 = 0 AS canonical FROM part WHERE p_partkey % 5 < 4),
y AS (SELECT *, max(CASE WHEN status = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY product) AS live FROM x)
SELECT product, p_partkey % 5 AS store FROM y WHERE live = 0 OR status = 'active' QUALIFY row_number() OVER (PARTITION BY product ORDER BY pri + CASE WHEN canonical THEN 3 ELSE 2 END DESC, p_partkey) = 1""")
def reference_choice(spark, sf_dir):
    """The listing by which each product is looked up; made-up listings never."""
    key = F.col("p_partkey")
    store = F.element_at(F.array(*map(F.lit, ("A", "b", "other", "d", "synthetic"))), (key % 5 + 1).cast("int"))
    url = F.concat(F.when(key % 5 == 4, "x://identity/").otherwise("http://s/"), key.cast("string"))
    d = t(spark, sf_dir, "part").select(F.floor(key / 5).cast("long").alias("product"), store.alias("store"), url.alias("url"), F.when(key % 7 == 0, url).alias("canonical_url"), key.cast("string").alias("product_id"), F.when(key % 3 == 0, "removed").otherwise("active").alias("status"), key.alias("ord"))
    priority = spark.createDataFrame([("a", 90), ("b", 75), ("d", 15)], "store string, priority int")
    chosen = matching.choose_reference(d, priority)
    place = F.when(F.lower("store") == "a", 0).when(F.col("store") == "b", 1).when(F.col("store") == "other", 2).otherwise(3)
    return chosen.select("product", place.cast("long").alias("store"))


@query("""SELECT vec_id, CASE WHEN vec_id % 12 >= 8 THEN 'skipped_limit' WHEN vec_id % 5 = 4 THEN 'skipped_deadline' WHEN vec_id % 7 = 0 THEN 'skipped_empty' WHEN b.embedding IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN vec_id % 12 < 8 AND vec_id % 5 < 4 AND vec_id % 7 > 0 THEN round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) END AS similarity FROM embeddings a LEFT JOIN (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings) b USING (vec_id)""")
def embedding_evidence(spark, sf_dir):
    from ..functions.values import cosine

    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.col("vec_id")
    other = e.select((n - 1).alias("vec_id"), F.col("embedding").alias("other"))
    told = matching.embedding_evidence(cosine(F.col("embedding"), F.col("other")), n % 12 + 1, F.when(n % 5 == 4, 4000).otherwise(10), F.when(n % 7 == 0, " ").otherwise("x"))
    return e.join(other, "vec_id", "left").select("vec_id", told.alias("e")).select("vec_id", "e.*")


@query("""SELECT p_partkey // 4 * 4 AS p_partkey, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM part GROUP BY p_partkey // 4""")
def eager_children(spark, sf_dir):
    """Parents with all their children in one pass."""
    p = t(spark, sf_dir, "part").select("p_partkey")
    group = F.floor(F.col("p_partkey") / 4) * 4
    children = p.select(group.cast("long").alias("parent"), F.col("p_partkey").alias("child"))
    parents = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("parent"))
    d = tables.with_children(parents, children, "parent", "children", ["child"])
    return d.select(F.col("parent").alias("p_partkey"), F.array_join(F.transform("children", lambda c: c["child"].cast("string")), ",").alias("keys"))
