"""Carrier sentences and the parts of invented personal data, for training the tagger: fixed values, and the rules that fill them.

A carrier is a sentence with slots: N a person's name, E an e-mail address, P a phone number, I an identity number,
A a street address; o (a body or place), k (a number of an order, part, version or book), h (a handle) and u (a machine
address) are no personal data.  Names, numbers and addresses are put together at random in many forms.
"""

from __future__ import annotations

import re

import numpy as np

from .pii_labels import KINDS

# Carriers of each language, one a line.
CARRIERS = {
    "en": r"""
I spoke with {N} yesterday about the delayed shipment.
Yesterday {N} sent the corrected version back to us.
His name is {N} and he lives at {A}.
Her name was {N}, but nobody used it.
According to {N}, the numbers were never checked.
The meeting was chaired by {N}; {N} took the minutes.
We asked {N} and {N} to review the second chapter.
Best regards, {N}
Kind regards,\n{N}\n{o}\n{P}\n{E}
Yours sincerely,\n{N}
Attendees: {N}, {N}, {N}
Present were {N} ({E}) and {N} ({E}).
Contact {N} at {E} or on {P}.
My father, {N}, was born near {o}.
{N} wrote the first draft, {N} the second.
{N} has worked for {o} since 1998.
{N}, who runs the workshop, agreed at once.
Did {N} ever answer your letter?
"It was late," said {N}, closing the door.
Dear {N}, thank you for the order {k}.
Dear Mr {N}, your ticket {k} was closed today.
Please forward this to {E} before Friday.
If you cannot reach me, write to {E}.
Mail: {E}; phone: {P}.
You can reach the office on {P} until noon.
My new number is {P}, please delete the old one.
Ring {P} and ask for {N}.
Fax {P}, mobile {P}
WhatsApp {P} works best in the evening.
Her passport, no. {I}, expires in June.
The applicant (SSN {I}) signed both forms.
Tax ID {I} belongs to {N}.
Driver's licence and ID card {I} were copied at the desk.
She lives at {A}, next to the bakery.
Send the samples to {A} by Monday.
The old office at {A} was sold.
Our address is {A}.
He moved from {A} to {A} in March.
Deliver to: {N}, {A}
The committee thanked {N} for the photographs of {o}.
The letter from {N} to the {o} is dated 4 May.
Version {k} of the manual was printed by the {o}.
Order {k} left the {o} on Tuesday, part {k} is missing.
The server {u} answered, the handle {h} did not.
Follow {h} or open ticket {k} at the {o}.
The {o} and the {o} met near {o}.
Page {k} of the book describes {o}, chapter {k} the {o}.
""",
    "de": r"""
Gestern habe ich mit {N} über die Lieferung gesprochen.
Das Protokoll führte {N}, den Vorsitz hatte {N}.
Herr {N} wohnt in der {A}.
Frau {N} ist unter {P} zu erreichen.
Laut {N} wurden die Zahlen nie geprüft.
Mit freundlichen Grüßen\n{N}
Viele Grüße, {N}
Mein Name ist {N}, meine Adresse lautet {A}.
Anwesend: {N}, {N} und {N}
Ansprechpartner: {N}, {P}, {E}
Schreiben Sie bitte an {E} oder rufen Sie {P} an.
{N} hat den Entwurf geschrieben, {N} hat ihn gekürzt.
{N} arbeitet seit 1998 beim {o}.
Die Unterlagen liegen bei {N} im {o}.
Wir danken {N} für die Fotos vom {o}.
Seine neue Nummer ist {P}.
Die Sendung geht an {N}, {A}.
Das Büro in der {A} wurde verkauft.
Ihr Ausweis mit der Nummer {I} läuft im Juni ab.
Die Steuernummer {I} gehört {N}.
Liebe {N}, vielen Dank für die Bestellung {k}.
„Es war spät“, sagte {N} und schloss die Tür.
Die Bestellung {k} verließ den {o} am Dienstag.
Der {o} und die {o} trafen sich in {o}.
Version {k} beschreibt Kapitel {k}, der Server {u} antwortet.
""",
    "fr": r"""
Hier, j'ai parlé avec {N} de la livraison.
Selon {N}, les chiffres n'ont jamais été vérifiés.
La réunion était présidée par {N} ; {N} a pris les notes.
Monsieur {N} habite au {A}.
Madame {N} répond au {P}.
Cordialement,\n{N}
Bien à vous, {N}
Je m'appelle {N} et mon adresse est {A}.
Présents : {N}, {N} et {N}
Contact : {N}, {P}, {E}
Écrivez à {E} ou téléphonez au {P}.
{N} a rédigé le premier texte, {N} le second.
{N} travaille pour {o} depuis 1998.
Nous remercions {N} pour les photos de {o}.
Mon nouveau numéro est le {P}.
Le colis part chez {N}, {A}.
L'ancien bureau du {A} a été vendu.
Son passeport, numéro {I}, expire en juin.
Le numéro fiscal {I} appartient à {N}.
Chère {N}, merci pour la commande {k}.
« Il était tard », dit {N} en fermant la porte.
La commande {k} a quitté {o} mardi.
{o} et {o} se sont réunis près de {o}.
La version {k} décrit le chapitre {k}, le serveur {u} répond.
""",
    "es": r"""
Ayer hablé con {N} sobre el envío.
Según {N}, las cifras nunca se comprobaron.
La reunión la presidió {N}; {N} tomó notas.
El señor {N} vive en {A}.
La señora {N} atiende en el {P}.
Un saludo,\n{N}
Atentamente, {N}
Me llamo {N} y mi dirección es {A}.
Asistentes: {N}, {N} y {N}
Contacto: {N}, {P}, {E}
Escriba a {E} o llame al {P}.
{N} escribió el primer borrador, {N} el segundo.
{N} trabaja para {o} desde 1998.
Agradecemos a {N} las fotos de {o}.
Mi nuevo número es el {P}.
El paquete es para {N}, {A}.
La antigua oficina de {A} se vendió.
Su pasaporte, número {I}, caduca en junio.
El número fiscal {I} pertenece a {N}.
Querida {N}, gracias por el pedido {k}.
«Era tarde», dijo {N} al cerrar la puerta.
El pedido {k} salió de {o} el martes.
{o} y {o} se reunieron cerca de {o}.
La versión {k} describe el capítulo {k}, el servidor {u} responde.
""",
    "zh": r"""
昨天我和{N}谈了交货的事。
据{N}说，数字从未核对过。
会议由{N}主持，{N}做了记录。
{N}先生住在{A}。
{N}女士的电话是{P}。
我叫{N}，地址是{A}。
出席者：{N}、{N}、{N}
联系人{N}，邮箱{E}。
联系{N}，电话{P}，邮箱{E}。
请写信到{E}，或拨打{P}。
初稿由{N}撰写，终稿由{N}修改。
{N}自1998年起在{o}工作。
感谢{N}提供{o}的照片。
我的新号码是{P}。
收件人{N}，{A}
旧办公室在{A}，已经卖掉。
他的护照号码是{I}，六月到期。
税号{I}属于{N}。
尊敬的{N}：您的订单{k}已发货。
“太晚了。”{N}关上门说。
此致\n{N}
订单{k}周二离开{o}。
{o}和{o}在{o}附近开会。
版本{k}描述了第{k}章，服务器{u}有响应。
""",
    "ja": r"""
昨日{N}さんと配送について話しました。
{N}によると、数字は確認されていない。
会議は{N}が司会し、{N}が記録した。
{N}様のご住所は{A}です。
{N}氏の電話番号は{P}です。
私の名前は{N}で、住所は{A}です。
出席者：{N}、{N}、{N}
連絡先は{N}、{E}です。
ご連絡は{E}または{P}まで。
初稿は{N}、最終稿は{N}が書いた。
{N}は1998年から{o}で働いている。
{o}の写真を提供した{N}に感謝します。
新しい番号は{P}です。
お届け先：{N}、{A}
旧事務所は{A}にあった。
彼の旅券番号は{I}で、六月に切れる。
納税者番号{I}は{N}のものだ。
{N}様、ご注文{k}を発送しました。
「もう遅い」と{N}は言った。
敬具\n{N}
注文{k}は火曜日に{o}を出た。
{o}と{o}が{o}の近くで会った。
版{k}は第{k}章を説明し、サーバー{u}は応答した。
""",
}

# Common given and family names.
GIVEN = {
    "en": "Alice Robert James Mary John Linda Michael Susan David Karen Emma Oliver Grace Henry Lucy George Helen Peter Jane Thomas Sarah Daniel Laura Paul Nancy Mark Julia Simon Rachel Andrew Claire Edward Ruth Victor Diana Philip Irene Frank Joan Martin Priya Omar Aisha Ivan Olga Kwame Fatima Raj Mei Yusuf",
    "de": "Klaus Anna Jürgen Sabine Wolfgang Ursula Hans Monika Stefan Petra Uwe Heike Matthias Birgit Andreas Katrin Jörg Silke Lukas Lena Jonas Mia Felix Greta Max Ida Friedrich Käthe Ernst Hannelore",
    "fr": "Jean Marie Pierre Camille Luc Sophie Michel Chloé Étienne Hélène Jacques Amélie Antoine Élise Nicolas Margaux Hugo Léa Gérard Odile Benoît Céline Thierry Inès Mathieu Zoé Rémi Agathe François Noémie",
    "es": "José María Carlos Lucía Javier Carmen Miguel Elena Antonio Pilar Luis Rosa Manuel Isabel Andrés Sofía Pablo Inés Diego Marta Álvaro Nuria Raúl Beatriz Sergio Paula Ramón Teresa Íñigo Ángela",
}
FAMILY = {
    "en": "Johnson Brown Smith Taylor Walker Harris Clark Lewis Young King Wright Green Baker Hall Adams Nelson Carter Mitchell Turner Parker Evans Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey Cooper O'Brien McDonald O'Neill MacLeod Patel Singh Khan Okafor Ivanova Petrov Nguyen Ahmed Fraser Whitfield Ashby Holloway Thornton Pemberton",
    "de": "Schmidt Müller Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Lange Werner Krause Lehmann Köhler Weiß Jäger Böhm Vogel Stein Groß Kaiser Pfeiffer",
    "fr": "Martin Bernard Dubois Durand Moreau Laurent Lefèvre Michel Garcia Roux Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau Vincent Muller Faure Mercier Blanc Guérin Boyer Garnier Chevalier François Legrand Gauthier Perrin d'Aubigny Lemaître Bélanger Côté Tremblay",
    "es": "García López Martínez Sánchez Pérez Gómez Fernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Serrano Blanco Molina Ortega Delgado Castro Ortiz Rubio Marín Núñez Iglesias Medina Garrido Ibáñez",
}
ZH_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙史陶贺顾毛郝龚邵万覃武钱戴严莫孔"
ZH_GIVEN = "明伟芳娜敏静丽强磊军洋勇艳杰娟涛超秀霞平刚桂英华玉兰红建国文辉志宇浩然子轩雨泽思梦佳欣怡晨阳博文雅婷俊豪嘉诚小晓春秋冬雪海波云龙凤梅竹菊安康宁乐瑞祥福贵成功立新永胜"
JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 福田 太田 西村 藤井 岡本 三浦 中野 原田 松田 竹内".split()
JA_GIVEN = "太郎 花子 一郎 健太 翔太 大輔 直樹 誠 学 浩 健一 隆 真由美 陽子 恵子 久美子 明美 由美 愛 美咲 葵 結衣 陽菜 蓮 大翔 悠真 湊 さくら あかり ひなた 拓也 達也 和也 剛 豊 茂 勇 実 清 進 智子 裕子 幸子 典子 亮 翼 楓 遥 凛 樹".split()
# Words of bodies and places that are no persons.
BODY = {
    "en": ("River Harbour Old North South Upper Lower Royal Green Silver Market Castle Abbey West East Central National Stone Kings Great Mill Hill", "Council Trust Museum Library Road Works Station Bridge Society Institute Press Hall Gardens Committee Company University Group Valley Park School Office Archive Park Alliance", "{a} {b}|{a} {c} {b}|{b} of {c}|{c} {b}|the {a} {b}|{c}|{a} {b} of {c}"),
    "de": ("Alte Neue Obere Untere Große Kleine Stadt Hafen Landes Bundes", "Rat Museum Bücherei Verein Brücke Amt Gesellschaft Verlag Bahnhof Stiftung Werkstatt Universität", "{a} {b}|{b} {c}|{c}er {b}|{c}"),
    "fr": ("Vieux Grand Petit Haut Bas Nouveau", "Conseil Musée Bibliothèque Société Institut Mairie Gare Pont Presse École Fondation", "{b} de {c}|le {a} {b}|la {b} de {c}|{c}|{a} {c}"),
    "es": ("Viejo Gran Nuevo Alto Bajo Real", "Consejo Museo Biblioteca Sociedad Instituto Ayuntamiento Estación Puente Editorial Escuela Fundación", "{b} de {c}|el {a} {b}|la {b} de {c}|{c}|{a} {c}"),
}
HAN_BODY = {"zh": "图书馆 博物馆 港口委员会 印刷厂 气象站 河务局 出版社 大学 车站 档案馆 学会 公司", "ja": "図書館 博物館 港湾局 印刷所 気象台 出版社 大学 駅 資料館 学会 株式会社 委員会"}
STREET = {
    "en": ("Oak Mill Church Station High Park Bridge Elm Cedar Maple Larch Chapel Victoria Baker Queen's Willow Garden Hazel Orchard Foundry", "Street Road Lane Avenue Drive Close Court Way Crescent Place St Rd Ave Blvd", "London Bristol Leeds York Denver Boston Austin Portland Dublin Cardiff"),
    "de": ("Haupt Bahnhof Garten Linden Schul Kirch Berg Wald Mühlen Rosen", "straße weg allee platz gasse str.", "Berlin München Köln Leipzig Bremen Hamburg Freiburg"),
    "fr": ("des Lilas|du Moulin|de la Gare|Victor Hugo|de l'Église|des Écoles|du Port|Saint-Michel", "rue|avenue|boulevard|place|chemin|impasse|quai|allée", "Paris Lyon Nantes Lille Rennes Nice Dijon"),
    "es": ("Mayor|del Sol|de la Paz|San Juan|de las Flores|del Molino|Real|de Goya", "Calle|Avenida|Plaza|Paseo|C/|Camino|Ronda", "Madrid Sevilla Bilbao Valencia Murcia Vigo"),
    "zh": ("中山 人民 解放 建设 和平 长江 文化 学院 花园 东风", "路 街 大道 巷", "北京市朝阳区 上海市徐汇区 广州市天河区 成都市武侯区 杭州市西湖区 海淀区 浦东新区"),
    "ja": ("神田 本町 桜丘 青葉 緑町 旭町 中央 栄町", "", "東京都千代田区 大阪府大阪市北区 京都府京都市中京区 北海道札幌市 横浜市西区"),
}
SYLLABLES = "ba be bo da de dor el fa gar hal i jo ka kel la len lo ma mar mel na nor o pa pel quen ra rin ro sa sel so ta tor u va vel wen wick yn za bri cla der fen gri holt kir mor ston thor whit".split()
HOSTS = "example mail post office nordpost webmail archive-net firma uni-west lab inbox".split()
ENDINGS = "com org net de fr es co.uk io edu example jp cn test".split()


def digits(rng, n: int) -> str:
    return "".join(str(x) for x in rng.integers(0, 10, n))


def shaped(rng, forms: list[str]) -> str:
    """A random form with figures for # and capital letters for @."""
    form = forms[rng.integers(len(forms))]
    return re.sub("[#@]", lambda m: str(rng.integers(10)) if m[0] == "#" else chr(65 + int(rng.integers(26))), form)


def coined(rng) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.integers(2, 4))).capitalize()


def pick(rng, words) -> str:
    words = words.split("|") if isinstance(words, str) and "|" in words else words.split() if isinstance(words, str) else words
    return str(words[rng.integers(len(words))]) if len(words) else ""


def name(rng, lang: str) -> str:
    if lang == "zh" and rng.random() < 0.9:
        return pick(rng, list(ZH_FAMILY)) + "".join(pick(rng, list(ZH_GIVEN)) if rng.random() < 0.8 else chr(int(rng.integers(0x4E00, 0x9FA0))) for _ in range(rng.integers(1, 3)))
    if lang == "ja" and rng.random() < 0.9:
        return pick(rng, JA_FAMILY) + ("" if rng.random() < 0.6 else " " if rng.random() < 0.7 else "　") + pick(rng, JA_GIVEN)
    lang = lang if lang in GIVEN else "en"
    one = lambda table: pick(rng, table[lang if rng.random() < 0.7 else pick(rng, list(GIVEN))]) if rng.random() < 0.65 else coined(rng)
    g, f = one(GIVEN), one(FAMILY)
    x = rng.random()
    if x < 0.08:
        f += "-" + one(FAMILY)
    elif x < 0.14:
        f = pick(rng, "van der|von|de|de la|del|di|le|zu|bin|Mac") + " " + f
    elif x < 0.2 and lang == "es":
        f += " " + one(FAMILY)
    x = rng.random()
    if x < 0.68:
        return f"{g} {f}"
    if x < 0.76:
        return f"{g[0]}. {f}"
    if x < 0.81:
        return f"{g} {one(GIVEN)[0]}. {f}"
    if x < 0.85:
        return f"{g[0]}. {one(GIVEN)[0]}. {f}"
    if x < 0.9:
        return f"{f}, {g}"
    if x < 0.94:
        return f"{g} {f}".upper()
    return f"{g} {one(GIVEN)} {f}"


def email(rng, lang: str) -> str:
    word = lambda: pick(rng, GIVEN["en"]).lower() if rng.random() < 0.4 else coined(rng).lower()
    left = pick(rng, ["{a}.{b}", "{a}", "{a}_{b}", "{a}{n}", "{a}-{b}", "{a}.{b}{n}", "{a}+{b}"]).format(a=word(), b=word(), n=rng.integers(1, 99))
    host = [pick(rng, HOSTS) if rng.random() < 0.5 else coined(rng).lower(), *pick(rng, ENDINGS).split(".")]
    if rng.random() < 0.2:
        host.insert(0, pick(rng, "mail|post|team"))
    x = rng.random()
    at, dot = ("@", ".") if x < 0.75 else (" [at] ", " [dot] ") if x < 0.8 else ("(at)", ".") if x < 0.85 else (" at ", " dot ") if x < 0.9 else ("[at]", "[dot]") if x < 0.93 else (" AT ", " DOT ") if x < 0.96 else (" @ ", ".")
    out = left.replace(".", dot if dot.strip() != "." and rng.random() < 0.2 else ".") + at + dot.join(host)
    return out.upper() if rng.random() < 0.03 and "@" in at else out


# Written forms of phone and identity numbers.
PHONES = {
    "en": ["+44 20 #### ####", "020 #### ####", "07### ######", "(###) ###-####", "###-###-####", "+1 ### ### ####", "+1-###-###-####", "0### ### ####", "+44 (0)20 #### ####", "###.###.####", "+353 1 ### ####"],
    "de": ["030 #######", "0## / ######", "+49 ### #######", "+49 (0)30 ######", "0151 ########", "0###-#######", "0049 ## ########"],
    "fr": ["01 ## ## ## ##", "06.##.##.##.##", "+33 6 ## ## ## ##", "07########", "+33 (0)1 ## ## ## ##", "04-##-##-##-##"],
    "es": ["6## ### ###", "9########", "+34 6## ### ###", "91 ### ## ##", "0034 9## ## ## ##"],
    "zh": ["13#########", "138 #### ####", "010-########", "+86 13# #### ####", "0755 #######", "(021) ########"],
    "ja": ["03-####-####", "090-####-####", "+81 3 #### ####", "0##-###-####", "080########", "06（####）####"],
}
IDS = {
    "en": ["###-##-####", "@@ ## ## ## @", "@@######@", "#########", "### ## ####", "@########", "@@#######"],
    "de": ["## ### ### ###", "###########", "@##@#####", "L########", "C##@@@##@#"],
    "fr": ["# ## ## ## ### ### ##", "###############", "##@@#####", "############"],
    "es": ["########@", "########-@", "X#######@", "@@@######", "##.###.###-@"],
    "zh": ["######19########", "######19######### @", "E########", "G########", "######20#######X"],
    "ja": ["#### #### ####", "############", "TK#######", "@@#######"],
}
IDS["zh"] = [x.replace(" @", "#") for x in IDS["zh"]]
NUMBERS = ["####-###-##", "#.##", "#.#.##", "####", "PO-#####", "@@-####", "###", "ISBN 978-#-##-######-#", "20##-##-##", "@##-###", "#######", "##/####", "R-###.#", "#,###", "SN@@######"]


def address(rng, lang: str) -> str:
    n = str(rng.integers(1, 240)) + (pick(rng, "a|b|B|C") if rng.random() < 0.12 else "")
    a, b, towns = STREET[lang]
    if lang in ("zh", "ja"):
        if lang == "zh":
            return (pick(rng, towns) if rng.random() < 0.7 else "") + pick(rng, a) + pick(rng, b) + n + "号" + (f"{rng.integers(1, 20)}栋{rng.integers(101, 2000)}室" if rng.random() < 0.4 else "")
        post = f"〒{digits(rng, 3)}-{digits(rng, 4)} " if rng.random() < 0.3 else ""
        return post + (pick(rng, towns) if rng.random() < 0.8 else "") + pick(rng, a) + pick(rng, [f"{rng.integers(1, 9)}-{rng.integers(1, 30)}-{rng.integers(1, 20)}", f"{rng.integers(1, 9)}丁目{rng.integers(1, 30)}番{rng.integers(1, 20)}号", f"{rng.integers(1, 9)}丁目{rng.integers(1, 30)}-{rng.integers(1, 9)}"])
    street = pick(rng, a) if rng.random() < 0.6 else coined(rng)
    town = pick(rng, towns) if rng.random() < 0.6 else coined(rng)
    tail = rng.random() < 0.6
    if lang == "en":
        flat = pick(rng, [f"Flat {rng.integers(1, 30)}, ", f"Apt {rng.integers(1, 30)}, ", f"Unit {rng.integers(1, 9)}, "]) if rng.random() < 0.2 else ""
        post = pick(rng, [shaped(rng, ["@@# #@@", "@## #@@", "@@## #@@", "@@#@ #@@"]), digits(rng, 5)])
        out = f"{flat}{n} {street} {pick(rng, b)}" + (pick(rng, [f", {town}", f", {town} {post}", f", {town}, {post}", f", {town}, {pick(rng, 'CA|NY|TX|OR')} {digits(rng, 5)}"]) if tail else "")
    elif lang == "de":
        street = street + pick(rng, b) if rng.random() < 0.8 else f"{pick(rng, 'Am|An der|Im')} {street}"
        out = f"{street} {n}" + (f", {digits(rng, 5)} {town}" if tail else "")
    elif lang == "fr":
        out = f"{n}{pick(rng, [' bis', '', '', '', ','])} {pick(rng, b)} {street}" + (f", {digits(rng, 5)} {town}" if tail else "")
    else:
        out = f"{pick(rng, b)} {street}{pick(rng, [', ', ' ', ', n.º '])}{n}" + (pick(rng, [", 2.º B", ", piso 3", ""]) if rng.random() < 0.2 else "") + (f", {digits(rng, 5)} {town}" if tail else "")
    return out.upper() if rng.random() < 0.08 else out


def body(rng, lang: str) -> str:
    if lang in HAN_BODY:
        return "".join(chr(int(rng.integers(0x4E00, 0x9FA0))) for _ in range(rng.integers(2, 5))) + pick(rng, "镇 桥 山 湾 市" if lang == "zh" else "岬 橋 山 市 町") * int(rng.integers(2)) + pick(rng, HAN_BODY[lang])
    a, b, forms = BODY[lang]
    return pick(rng, forms).format(a=pick(rng, a), b=pick(rng, b), c=coined(rng))


def machine(rng) -> str:
    return pick(rng, [".".join(str(x) for x in rng.integers(0, 255, 4)), f"{coined(rng).lower()}-{rng.integers(1, 99)}.internal", f"{digits(rng, 4)}:{digits(rng, 4)}::{rng.integers(1, 99)}", f"{digits(rng, 2)}:{digits(rng, 2)}:ab:{digits(rng, 2)}", f"git@{coined(rng).lower()}.host:repo"])

# Parts of sentences that are put together at random around a name: roles (R), verbs (V), objects (O),
# times and places (T), what stands before a name that is no subject (W), and how it all is ordered; and what stands
# before identity numbers (I), phone numbers (P) and addresses (A).
PARTS = {
    "en": {
        "R": "our neighbour|the gardener|the new clerk|my cousin|her brother|the teacher|professor|Captain|the witness|our colleague|the painter|the plumber|aunt|uncle|president|the author|the tenant|Doctor|Judge|the driver",
        "V": "bought|left|found|signed|painted|lost|sold|repaired|brought|saw|wrote|broke|kept|sent|closed|counted|knew|feared|missed|asked for|was told about|stayed for|voted against|laughed at|waited for|had forgotten",
        "O": "the ledger|the painting|a new bicycle|the keys|two letters|the garden|the old boat|the invoice|the meeting|the bridge|a loaf of bread|the questions|the last train|the contract|the cats|an offer|the roof",
        "T": "in spring|after the talk|before the alarm|last night|at the auction|near the church|without a word|twice|in 1987|on Monday|for the first time|with great care|during the break|at noon|some years ago",
        "W": "by|with|from|for|to|about|and|except|like|between|of|behind|against|but|after|than|that|when|because|only|while",
        "F": "{N} {V} {O} {T}.|{T}, {N} {V} {O}.|{T} {N} {V} {O}, then {N} {V} {O}.|{R} {N} {V} {O}.|{N}, {R}, {V} {O} {T}.|{O} was {V} {W} {N} {T}.|nobody {W} {N} {V} {O}.|it was {O} {W} {N} that {R} {V}.|{N}'s brother {V} {O}.|{o} {V} {O} {T}.|{R} {V} {O} {W} {o}.|{T} {R} {V} {O}.|{N}\n{O} {T}|{N} - {R}|{O} ({N})|{N} and {N} {V} {O}.|{R} of {o} {V} {O} {W} {N}.|{N} is {R}.|{R}: {N}",
        "I": "national identity number|passport|passport no.|ID card|identity card number|tax number|tax ID|SSN|social security no.|driving licence|NI number|national insurance|residence permit|ID number",
        "P": "tel.|phone|call|ring|mobile|fax|try|my number is|dial|cell|text|reach us on|hotline|telephone number", "A": "at|to|lives at|the house at|address|from|the flat at|visit us at|near|deliver to|the clinic at|based at|moved to",
    },
    "de": {
        "R": "unsere Nachbarin|der Gärtner|die neue Sekretärin|mein Vetter|ihr Bruder|der Lehrer|Professor|Kapitän|die Zeugin|unser Kollege|die Malerin|Tante|Onkel|Präsident|der Mieter|Doktor|Richterin|die Praxis|der Fahrer|die Rechnung|das Bild",
        "V": "kaufte|verließ|fand|unterschrieb|malte|verlor|verkaufte|reparierte|brachte|sah|schrieb|zerbrach|behielt|schickte|schloss|zählte|kannte|vergaß|fürchtete|öffnete|fütterte|bemerkte",
        "O": "das Kassenbuch|das Bild|ein neues Fahrrad|die Schlüssel|zwei Briefe|den Garten|das alte Boot|die Rechnung|die Sitzung|die Brücke|ein Brot|die Fragen|den letzten Zug|den Vertrag|die Katzen|das Dach",
        "T": "im Frühling|nach dem Vortrag|vor dem Alarm|gestern Abend|auf der Auktion|bei der Kirche|ohne ein Wort|zweimal|im Jahr 1987|am Montag|zum ersten Mal|in der Pause|mittags|vor einigen Jahren",
        "W": "von|mit|für|bei|an|über|und|außer|wie|zwischen|hinter|gegen|aber|nach|als|dass|weil|nur",
        "F": "{N} {V} {O} {T}.|{T} {V} {N} {O}.|{R} {N} {V} {O}.|{N}, {R}, {V} {O} {T}.|niemand {W} {N} {V} {O}.|{O} {V} {N} {T}.|{O} {W} {N} {V} {R}.|{o} {V} {O} {T}.|{R} {V} {O} {W} {o}.|{T} {V} {R} {O}.|{R} in der Stadt {V} {T}.|{N}\n{O}|{R}: {N}|{O} ({N})|{N} und {N} {V} {O}.|{O} {W} {o} {V} {N}.",
        "I": "Ausweis|Ausweisnummer|Personalausweis Nr.|Reisepass|Passnummer|Steuernummer|Steuer-ID|Sozialversicherungsnummer|Führerschein|Identifikationsnummer",
        "P": "Tel.|Telefon|unter|Mobil|Fax|Rufnummer|Handy|erreichbar unter|Telefonnummer|Durchwahl", "A": "in der|im Haus|Adresse|Anschrift|wohnt|nach|die Praxis|aus der|liefern an|an",
    },
    "fr": {
        "R": "notre voisine|le jardinier|la nouvelle secrétaire|mon cousin|son frère|le professeur|capitaine|la témoin|notre collègue|la peintre|tante|oncle|président|le locataire|docteur|le conducteur|le cabinet|la facture",
        "V": "acheta|quitta|trouva|signa|peignit|perdit|vendit|répara|apporta|vit|écrivit|cassa|garda|envoya|ferma|compta|connaissait|oublia|a vendu|a réparé|a signé|nourrit",
        "O": "le registre|le tableau|un vélo neuf|les clés|deux lettres|le jardin|le vieux bateau|la facture|la réunion|le pont|un pain|les questions|le dernier train|le contrat|les chats|le toit",
        "T": "au printemps|après l'exposé|avant l'alarme|hier soir|à la vente|près de l'église|sans un mot|deux fois|en 1987|lundi|pour la première fois|pendant la pause|à midi|il y a des années",
        "W": "par|avec|de|pour|à|sur|et|sauf|comme|entre|derrière|contre|mais|après|que|parce que|seulement",
        "F": "{N} {V} {O} {T}.|{T}, {N} {V} {O}.|{R} {N} {V} {O}.|{N}, {R}, {V} {O} {T}.|personne {W} {N} ne {V} {O}.|{O} {W} {N} {T}.|{o} {V} {O} {T}.|{R} {V} {O} {W} {o}.|{T}, {R} {V} {O}.|{N}\n{O}|{R} : {N}|{O} ({N})|{N} et {N} {V} {O}.|{O} de {o} {V} {W} {N}.",
        "I": "passeport|carte d'identité|numéro d'identité|numéro fiscal|numéro de sécurité sociale|permis de conduire|NIR|titre de séjour",
        "P": "tél.|téléphone|appelez le|au|mobile|fax|portable|composez le|essayez le|numéro", "A": "au|à|adresse|habite|chez|situé|le cabinet du|livrer au|du|vers le",
    },
    "es": {
        "R": "nuestra vecina|el jardinero|la nueva secretaria|mi primo|su hermano|el profesor|capitán|la testigo|nuestro colega|la pintora|tía|tío|presidente|el inquilino|doctor|el conductor|la consulta|la factura",
        "V": "compró|dejó|encontró|firmó|pintó|perdió|vendió|reparó|trajo|vio|escribió|rompió|guardó|envió|cerró|contó|conocía|olvidó|temía|abrió",
        "O": "el libro|el cuadro|una bicicleta nueva|las llaves|dos cartas|el jardín|el viejo barco|la factura|la reunión|el puente|un pan|las preguntas|el último tren|el contrato|los gatos|el tejado",
        "T": "en primavera|después de la charla|antes de la alarma|anoche|en la subasta|cerca de la iglesia|sin una palabra|dos veces|en 1987|el lunes|por primera vez|durante la pausa|a mediodía|hace años",
        "W": "por|con|de|para|a|sobre|y|salvo|como|entre|detrás de|contra|pero|tras|que|porque|solo",
        "F": "{N} {V} {O} {T}.|{T}, {N} {V} {O}.|{R} {N} {V} {O}.|{N}, {R}, {V} {O} {T}.|nadie {W} {N} {V} {O}.|{O} lo {V} {N} {T}.|{o} {V} {O} {T}.|{R} {V} {O} {W} {o}.|{T}, {R} {V} {O}.|{N}\n{O}|{R}: {N}|{O} ({N})|{N} y {N} {V} {O}.|{O} de {o} {V} {W} {N}.",
        "I": "pasaporte|DNI|NIE|número de identidad|número fiscal|seguridad social|permiso de conducir|cédula",
        "P": "tel.|teléfono|llame al|al|móvil|fax|marque el|pruebe el|número", "A": "en|a|dirección|vive en|la consulta de|domicilio|desde|entregar en|junto a",
    },
    "zh": {
        "R": "邻居|园丁|新来的秘书|表哥|老师|教授|船长|证人|同事|画家|阿姨|主任|租客|医生|司机|经理|作者|校长|记者|会计",
        "V": "买下了|离开了|找到了|签了|画了|丢了|卖掉了|修好了|带来了|看见|写了|打破了|留下|寄出了|关上了|数过|认识|忘了|害怕|检查了|喂养|说起|回答了|等待|推迟了",
        "O": "账本|这幅画|新自行车|钥匙|两封信|花园|旧船|发票|会议|桥梁|面包|问题|末班车|合同|猫|屋顶|潮汐表|水泵|诊所",
        "T": "春天|讲座结束后|警报响起之前|昨晚|在拍卖会上|在教堂附近|一言不发|两次|1987年|周一|第一次|休息时|中午|多年前|后来|当时",
        "W": "由|和|跟|对|给|被|向|替|除了|关于|像|比|因为|只有|把|让|请|据|是|连|为",
        "F": "{N}{V}{O}。|{T}，{N}{V}{O}。|{T}{N}{V}{O}。|{O}{W}{N}{V}。|{R}{N}{V}{O}。|{W}{N}，没人{V}{O}。|{O}是{N}{T}{V}的。|{N}、{N}{V}{O}。|{W}{N}，{R}{V}{O}。|{R}：{N}|{N}\n{O}|{O}（{N}）|{o}{V}{O}。|{T}{R}{V}{O}。|{R}{T}{V}{o}的{O}。|{R}{W}{N}{V}{O}，{T}{V}{O}。|我们的{R}{N}{T}{V}{O}。|{O}{V}，{N}{V}。|{T}{V}{O}的是{N}。",
        "I": "护照|护照号码|身份证|身份证号码|证件号|税号|驾照号|社保号|居留证",
        "P": "电话|手机|请打|拨打|致电|传真|号码是|先打|联系电话", "A": "位于|住在|地址|在|寄到|送到|搬到|住址是|诊所在|地点",
    },
    "ja": {
        "R": "隣人|庭師|新しい秘書|従兄|先生|教授|船長|証人|同僚|画家|叔母|会長|借主|医師|運転手|課長|作者|校長|記者",
        "V": "買った|去った|見つけた|署名した|描いた|失くした|売った|直した|持ってきた|見た|書いた|壊した|残した|送った|閉めた|数えた|知っていた|忘れた|恐れた|調べた|答えた",
        "O": "帳簿|この絵|新しい自転車|鍵|二通の手紙|庭|古い船|請求書|会議|橋|パン|質問|終電|契約|猫|屋根|潮汐表|ポンプ|診療所",
        "T": "春に|講演のあと|警報の前に|昨夜|競売で|教会の近くで|黙って|二度|1987年に|月曜に|初めて|休憩中に|正午に|数年前に|その後",
        "W": "と|や|へ|から|より|だけ|以外に|について|のように|ため",
        "F": "{N}が{O}を{V}。|{T}、{N}は{O}を{V}。|{T}{N}が{O}を{V}。|{O}は{N}が{T}{V}。|{R}の{N}が{O}を{V}。|{N}{W}{R}が{O}を{V}。|{N}、{N}が{O}を{V}。|{O}を{V}のは{N}だ。|{R}：{N}|{N}\n{O}|{O}（{N}）|{o}が{O}を{V}。|{T}、{R}が{O}を{V}。|{R}は{o}の{O}を{T}{V}。|{O}には{N}の名がある。|{N}も{O}を{V}。|{N}に{O}を{V}。|{N}の{O}を{R}が{V}。",
        "I": "旅券番号|パスポート|マイナンバー|個人番号|免許証番号|在留カード|納税者番号|身分証番号",
        "P": "電話|携帯|お電話は|まず|番号は|ファクス|連絡先|内線", "A": "住所|住所は|所在地|から|まで|宛先|診療所は|お届け先|会社は",
    },
}


def composed(lang: str, rng) -> str:
    """A carrier put together from PARTS."""
    p = PARTS[lang]
    x = rng.random()
    tight = lang in ("zh", "ja")
    if x < 0.2:
        slot = "IPA"[rng.integers(3)]
        cue = pick(rng, p[slot].split("|"))
        sep = pick(rng, ["：", "", "", " ", ":", "是", "，"] if tight else [" ", " ", ": ", " : ", ", ", " is ", " - "])
        after = pick(rng, ["。", "。", "，", "\n", ""]) if tight else pick(rng, [".", ".", ",", "\n", " ", ""])
        head = pick(rng, p["T"].split("|")) if rng.random() < 0.4 else pick(rng, p["R"].split("|")) if rng.random() < 0.5 else ""
        tail = pick(rng, p["T"].split("|")) if rng.random() < 0.5 else ""
        out = head + ("" if tight or not head else " ") + cue + sep + "{%s}" % slot + after + ("" if tight or not tail else " ") + tail
    else:
        form = pick(rng, p["F"].split("|"))
        out = re.sub(r"\{([RVOTW])\}", lambda m: pick(rng, p[m[1]].split("|")), form)
    return out[:1].upper() + out[1:] if rng.random() < 0.8 else out

# What stands before numbers that are no personal data, and things of one's own, by language.
NUMBERED = {
    "en": ("order|invoice|batch|model|ticket|flight|room|page|version|part|issue|lot|serial|build|article", "my house|my question|your answer|his bag|our plan|her car|their dog|my team|your turn|our shop"),
    "de": ("Auftrag|Rechnung|Charge|Modell|Ticket|Flug|Zimmer|Seite|Fassung|Teil|Posten|Artikel|Bestellung", "mein Haus|meine Frage|deine Antwort|seine Tasche|unser Plan|ihr Wagen|Ihre Karte|mein Team|unser Laden"),
    "fr": ("commande|facture|lot|modèle|billet|vol|chambre|page|version|pièce|article|dossier", "ma maison|ma question|ta réponse|son sac|notre plan|sa voiture|leur chien|mon équipe|notre magasin"),
    "es": ("pedido|factura|lote|modelo|billete|vuelo|habitación|página|versión|pieza|artículo|expediente", "mi casa|mi pregunta|tu respuesta|su bolso|nuestro plan|su coche|mi equipo|nuestra tienda"),
    "zh": ("订单|发票|批次|型号|票据|航班|房间|页码|版本|零件|货号|工单", "我家|我的问题|你的回答|他的包|我们的计划|她的车"),
    "ja": ("注文|請求書|ロット|型番|切符|便|部屋|頁|版|部品|品番|案件", "私の家|私の質問|君の答え|彼の鞄|我々の計画|彼女の車"),
}


def aside(lang: str, rng) -> str:
    """A carrier without personal data: numbered things, and things of one's own that begin a sentence."""
    p, (numbered, own) = PARTS[lang], NUMBERED[lang]
    one = lambda x: pick(rng, x.split("|"))
    tight = lang in ("zh", "ja")
    gap = "" if tight else " "
    number = one(numbered) + pick(rng, ["", "号", "：", " "] if tight else [" ", " ", " no. ", " #", ": "]) + "{k}"
    forms = [one(own) + gap + one(p["V"]) + gap + one(p["O"]), number + gap + one(p["V"]) + gap + one(p["T"]), "{o}" + gap + one(p["V"]) + gap + number, one(p["T"]) + gap + one(own) + gap + one(p["V"]) + gap + number, one(p["R"]) + gap + one(p["V"]) + gap + number]
    out = forms[rng.integers(len(forms))] + ("。" if tight else ".")
    return out[:1].upper() + out[1:]


def filled(carrier: str, lang: str, rng) -> tuple[str, list[tuple[int, int, int]]]:
    """The carrier with its slots filled, and (start, end, kind) of the personal data."""
    out, spans, n = [], [], 0
    make = {
        "N": name, "E": email, "A": address, "o": body, "P": lambda r, x: shaped(r, PHONES[x]), "I": lambda r, x: shaped(r, IDS[x]),
        "k": lambda r, x: shaped(r, NUMBERS), "h": lambda r, x: pick(r, "@|#|u/|~") + coined(r).lower() + pick(r, ["_", ".", ""]) + coined(r).lower(), "u": lambda r, x: machine(r),
    }
    kind = {"E": "email", "P": "phone", "I": "id_number", "A": "street_address", "N": "person_name"}
    for part in re.split(r"(\{\w\})", carrier):
        if re.fullmatch(r"\{\w\}", part):
            slot = part[1]
            part = make[slot](rng, lang)
            if slot in kind:
                spans.append((n, n + len(part), KINDS.index(kind[slot])))
        out.append(part)
        n += len(part)
    return "".join(out), spans


def lines(lang: str) -> list[str]:
    return [x.replace("\\n", "\n") for x in CARRIERS[lang].strip().split("\n")]
