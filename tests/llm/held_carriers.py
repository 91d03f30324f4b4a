"""Carrier sentences that the tagger's training never sees; slots as in pii_carriers.

They share neither sentences nor the verbs, objects and roles that training composes carriers from.
"""

HELD = {
    "en": r"""
Rumour has it that {N} will retire before Easter.
The trophy went to {N}, runner-up {N} took silver.
Please tell {N} the parcel arrived damaged.
{N} teaches chemistry and lives close to the station.
Speakers this evening: {N} and {N}.
Love,\n{N}
On behalf of {N}, thank you all for coming.
Questions? Email {E} any time.
My line is {P}, extension four.
Our studio moved to {A} last autumn.
Her ID card number {I} had expired.
A cheque from {N} reached the {o} yesterday.
The {o} cancelled shipment {k} because of snow.
""",
    "de": r"""
Gerüchten zufolge geht {N} vor Ostern in Rente.
Der Pokal ging an {N}, Silber holte {N}.
Bitte richten Sie {N} aus, dass das Paket beschädigt ankam.
{N} unterrichtet Chemie und wohnt nahe dem Bahnhof.
Im Namen von {N} herzlichen Dank.
Fragen? Jederzeit an {E}.
Meine Nummer lautet {P}.
Unser Atelier zog im Herbst in die {A}.
Das {o} sagte die Lieferung {k} wegen Schnee ab.
""",
    "fr": r"""
On dit que {N} prendra sa retraite avant Pâques.
La coupe revient à {N}, l'argent à {N}.
Dites à {N} que le colis est arrivé abîmé.
{N} enseigne la chimie et vit près de la gare.
Au nom de {N}, merci à tous.
Des questions ? Écrivez à {E}.
Ma ligne directe : {P}.
Notre atelier a déménagé au {A}.
{o} a annulé la livraison {k} à cause de la neige.
""",
    "es": r"""
Se rumorea que {N} se jubilará antes de Pascua.
El trofeo fue para {N}, la plata para {N}.
Dígale a {N} que el paquete llegó roto.
{N} enseña química y vive junto a la estación.
En nombre de {N}, gracias a todos.
¿Preguntas? Escriba a {E}.
Mi línea es el {P}.
Nuestro estudio se mudó a {A}.
{o} canceló el envío {k} por la nieve.
""",
    "zh": r"""
据传{N}将在复活节前退休。
冠军是{N}，亚军是{N}。
麻烦转告{N}包裹破损了。
{N}教化学，家在车站旁边。
谨代表{N}感谢各位光临。
如有疑问请发邮件至{E}。
我的专线是{P}。
工作室去年秋天搬到了{A}。
{o}因下雪取消了货运{k}。
""",
    "ja": r"""
噂では{N}が復活祭の前に引退する。
優勝は{N}、準優勝は{N}だった。
荷物が破損していたと{N}に伝えてください。
{N}は化学を教え、駅のそばに住む。
{N}を代表して皆様に感謝します。
ご質問は{E}までどうぞ。
直通は{P}です。
工房は昨年の秋に{A}へ移った。
{o}は雪のため出荷{k}を取りやめた。
""",
}
