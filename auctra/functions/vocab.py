"""Word lists, aliases and patterns that results depend on."""

from __future__ import annotations

#: District phrase in an address -> short code.
DISTRICTS = {
    "Центральный административный округ": "ЦАО",
    "Западный административный округ": "ЗАО",
    "Северо-Западный административный округ": "СЗАО",
    "Северный административный округ": "САО",
    "Северо-Восточный административный округ": "СВАО",
    "Восточный административный округ": "ВАО",
    "Юго-Восточный административный округ": "ЮВАО",
    "Южный административный округ": "ЮАО",
    "Юго-Западный административный округ": "ЮЗАО",
    "Зеленоградский административный округ": "ЗелАО",
    "Новомосковский административный округ": "НАО",
    "Троицкий административный округ": "ТАО",
}
UNKNOWN_DISTRICT = "Неизвестно"

#: Floor labels in display order.
FLOORS = ["Подвал", "Цоколь", "0 этаж", "1 этаж", "2 этаж", "3 этаж", "4 этаж", "5+ этаж", "Антресоль", "Мансарда", "Чердак", "Техэтаж", "Мезонин", "Многоуровневый", "Не указано"]

#: Part of a floor text -> label, first hit wins.
FLOOR_WORDS = [("подвал", "Подвал"), ("цок", "Цоколь"), ("антрес", "Антресоль"), ("мансард", "Мансарда"), ("чердак", "Чердак"), ("тех", "Техэтаж"), ("мезонин", "Мезонин")]

#: Words after which an address names a room, not a building.
ROOM_WORDS = ["этаж", "помещение", "комната", "офис", "кабинет", "антресоль", "подвал", "цоколь", "чердак", "мансарда", "квартира"]

#: Whole-word address rules (pattern, replacement), in order.
ADDRESS_RULES = [
    (r"российская федерация", " "),
    (r"внутригородская территория муниципальный округ", " "),
    (r"муниципальный округ", " "),
    (r"город федерального значения", " "),
    (r"г(?:ород)?\.?\s*москва", " "),
    (r"г(?:ород)?", " "),
    (r"москва", " "),
    (r"(?:центральный|северный|северо-восточный|восточный|юго-восточный|южный|юго-западный|западный|северо-западный|зеленоградский|троицкий|новомосковский)\s+административный\s+округ", " "),
    (r"район", " "),
    (r"поселение", " "),
    (r"территория", " "),
    (r"ул(?:ица)?", "улица"),
    (r"пр-?кт", "проспект"),
    (r"пр-т", "проспект"),
    (r"пер", "переулок"),
    (r"бул", "бульвар"),
    (r"наб\.?", "набережная"),
    (r"пл", "площадь"),
    (r"ш", "шоссе"),
    (r"туп", "тупик"),
    (r"пр", "проезд"),
    (r"д(?:ом)?", "дом"),
    (r"к(?:орпус)?", "корпус"),
    (r"стр(?:оение)?", "строение"),
    (r"соор(?:ужение)?", "сооружение"),
    (r"вл", "владение"),
]

#: Street types that the match address leaves out.
STREET_TYPES = ["улица", "переулок", "проспект", "бульвар", "набережная", "площадь", "шоссе", "тупик", "проезд", "аллея"]

#: Rubrics that are no tenants, by rule set.
IMPLAUSIBLE_RUBRICS = {
    "match": [
        "Станции зарядки телефонов", "Станции зарядки мобильных телефонов", "Постаматы", "Питьевая вода", "Кофейные автоматы", "Банкоматы", "Терминалы оплаты",
        "Платёжные терминалы", "Детские развлекательные автоматы", "Фотокабины / Автоматы фотопечати", "Копировальные услуги", "Государственные дошкольные учреждения",
        "Общеобразовательные школы", "Органы государственной власти", "Многофункциональные центры", "Библиотеки", "Аварийные / справочные / экстренные службы",
        "Жилищно-коммунальные", "Правоохранительные органы", "Новостройки", "Общественные / политические организации",
    ],
    "revalidate": [
        "Станции зарядки телефонов", "Постаматы", "Питьевая вода", "Кофейные автоматы", "Аварийные / справочные / экстренные службы -> Справочные",
        "Жилищно-коммунальные", "Правоохранительные органы", "Новостройки -> Новостройки", "Общественные / политические организации",
    ],
}
IMPLAUSIBLE_NAMES = {
    "match": [
        "банкомат", "5post", "5 post", "qiwi", "киви", "бери заряд", "автомат по продаже кофе", "кофейный автомат", "зарядная станция", "контейнер для сбора",
        "пункт сбора отработанных", "приема батареек", "приёма батареек", "добрыекрышечки", "немузеймусора", "автомат с ", "пункт приёма", "пункт приема", "автомат копировальных",
    ],
    "revalidate": ["контейнер для сбора", "пункт сбора отработанных", "приема батареек", "приёма батареек"],
}
#: Names that look like an address.
ADDRESS_NAME_TYPES = ["улица", "переулок", "проспект", "бульвар", "шоссе", "набережная", "площадь", "проезд", "тупик"]

#: Lower-cased company name -> canonical name; the second list is used in histories only.
COMPANY_ALIASES = {
    "wildberries": "Wildberries", "вайлдберриз": "Wildberries", "ozon": "Ozon", "озон": "Ozon", "яндекс маркет": "Яндекс Маркет", "яндекс.маркет": "Яндекс Маркет",
    "сдэк": "СДЭК", "cdek": "СДЭК", "авито": "Авито", "магнит": "Магнит", "пятёрочка": "Пятёрочка", "пятерочка": "Пятёрочка", "вкусвилл": "ВкусВилл", "вкус вилл": "ВкусВилл",
    "fix price": "Fix Price", "фикс прайс": "Fix Price", "красное&белое": "Красное&Белое", "красное & белое": "Красное&Белое", "винлаб": "Винлаб", "dns": "DNS", "днс": "DNS",
    "перекрёсток": "Перекрёсток", "перекресток": "Перекрёсток", "лента": "Лента", "московское долголетие": "Московское долголетие", "ямосковское долголетие": "Московское долголетие",
    "центр московского долголетия и молодости": "Московское долголетие", "центр московского долголетия": "Московское долголетие",
}
HISTORY_ALIASES = COMPANY_ALIASES | {
    "invitro": "INVITRO", "инвитро": "INVITRO", "coral travel": "Coral Travel", "coral travel москва": "Coral Travel", "eurospar": "Eurospar", "eurospar express": "Eurospar Express",
}

#: Tokens that say nothing in a company name.
NAME_NOISE = ["ооо", "ип", "ао", "зао", "пао", "компания", "студия", "клуб", "центр", "магазин", "салон", "сеть", "район", "филиал", "пункт", "мастерская", "школа", "интернет", "сайт", "online", "ru", "com", "рф"]

#: Part of a usage text -> retail category, first hit wins.
RETAIL_CATEGORIES = [
    ("Пункты выдачи интернет-заказов", "Пунк выдачи"), ("Супермаркеты", "Супермаркет/Гипермаркет"), ("Дарксторы", "Дарксторы"), ("Алкогольные напитки", "Алкомаркеты"),
    ("Аптеки", "Аптеки"), ("Медицинские товары", "Аптеки"), ("Быстрое питание", "Общепит"), ("Рестораны", "Общепит"), ("Кафе", "Общепит"), ("Бары", "Общепит"),
    ("Продуктовые магазины", "Продукты"), ("Доставка продуктов", "Продукты"), ("Барбершопы", "Салоны красоты, барбершопы, парикмахерские"),
    ("Парикмахерские", "Салоны красоты, барбершопы, парикмахерские"), ("Ювелирн", "Ювелирный"), ("Оптика", "Оптика"), ("Обувь", "Обувь"), ("Спортивн", "Спорт"),
    ("Товары для дома", "Товары для дома"), ("Мебель", "Мебель"), ("Стройматериалы", "Стройматериалы"), ("Натяжные потолки", "Стройматериалы"),
    ("Электронник", "Электронника, бытовая техника"), ("Бытовая техника", "Электронника, бытовая техника"), ("Зоомагазин", "Зоомагазины"), ("Уход за животными", "Зоомагазины"),
    ("Детские товары", "Детские товары"), ("Банки", "Банки"), ("Страхование", "Банки"), ("Кофе с собой", "Кофе с собой"), ("Салоны связи", "Салоны связи"),
    ("Парфюмери", "Парфюмерия и косметика"), ("Косметик", "Парфюмерия и косметика"), ("Фото", "Фото/печатные салоны"), ("Пункт выдачи", "Пунк выдачи"),
]
ALCOHOL_CATEGORY = "Алкомаркеты"

#: The rubric that charts show as pick-up points.
PICKUP_RUBRIC, PICKUP_CATEGORY = "Грузоперевозки / Транспортные услуги", "Маркетплейсы (ПВЗ)"
#: Words by which a chain asks for the first floor.
FIRST_FLOOR_WORDS = "1 этаж|первый этаж|1-ом|1-й|1 эт"
#: Parts of an entrance text and their kind, first hit wins.
ENTRY_KINDS = [("отдель", "street"), ("подъезд", "hallway"), ("места общего пользования", "common"), ("иную собственность", "shared")]
#: Headings of suggested uses, in the order of their rules; then the general ones and the filler.
USES = [
    "Пункт выдачи заказов и микро-ритейл", "Кафе, кофейня to-go или пекарня", "Клиентский офис или сервисный центр", "Образовательная площадка или детский клуб",
    "Фитнес, йога или танцевальная студия", "Мастерские, студии или бэк-офис", "Кабинеты услуг по записи", "Шоурум маркетплейса или демонстрационный зал",
    "Мультимедийные/креативные студии", "Фуд-маркет локального масштаба или гастропарк",
]
GENERAL_USES = ["Гибкий склад-офис для e-commerce", "Социальные сервисы", "Частная клиника или стоматология", "IT- или цифровой кампус"]
FILLER_USE = "Многофункциональная площадка с гибким графиком"

#: Entrance in any source vocabulary -> label.
ENTRANCES = {
    "отдельный": "отдельный", "общий": "общий",
    "отдельный с улицы": "отдельный с улицы", "separateFromTheStreet": "отдельный с улицы", "separateFromStreet": "отдельный с улицы",
    "отдельный со двора": "отдельный со двора", "separateFromTheYard": "отдельный со двора", "separateFromYard": "отдельный со двора",
    "общий с улицы": "общий с улицы", "commonFromStreet": "общий с улицы", "commonFromTheStreet": "общий с улицы",
    "общий со двора": "общий со двора", "commonFromYard": "общий со двора", "commonFromTheYard": "общий со двора",
    "через подъезд": "через подъезд", "throughEntrance": "через подъезд", "через холл": "через холл", "throughHall": "через холл",
}
#: Entrance of a lot -> listing vocabulary.
LOT_ENTRANCES = {
    "отдельный": "отдельный с улицы", "вход через места общего пользования": "общий с улицы", "вход через подъезд": "общий с улицы",
    "nsi:1032:103201": "отдельный с улицы", "nsi:1032:1032004": "общий с улицы", "nsi:1032:1032005": "общий с улицы", "nsi:1032:1032006": "общий с улицы",
}
#: Entrance code of a lot -> display label; an unknown code is "Не указано".
ENTRANCE_CODES = {
    "nsi:1032:103201": "Отдельный", "nsi:1032:1032004": "Вход через подъезд", "nsi:1032:1032005": "Вход через места общего пользования",
    "nsi:1032:1032006": "Вход через подъезд", "nsi:1032:9001302": "",
}
#: Floor of a lot -> listing vocabulary.
LOT_FLOORS = {
    "подвал": "цоколь", "подвальный": "цоколь", "цоколь": "цоколь", "цокольный": "цоколь", "полуподвал": "цоколь", "1 пол": "цоколь", "техническое подполье": "цоколь",
    "1 этаж": "1", "антресоль": "2", "мезонин": "1", "2 этаж и выше": "3+", "мансарда": "3+", "чердак": "3+",
}
#: Purpose of a lot -> object type of listings.
LOT_PURPOSES = {
    "свободное": "Помещение свободного назначения", "бытовые услуги": "Торговое помещение", "торговое": "Торговое помещение", "офис": "Офисное помещение", "офисное": "Офисное помещение",
}
#: Part of an object type -> class, first hit wins; anything else is "other".
OBJECT_CLASSES = [("торг", "retail"), ("магаз", "retail"), ("розниц", "retail"), ("офис", "office"), ("склад", "warehouse"), ("произв", "warehouse"), ("свобод", "flex"), ("универс", "flex"), ("назначен", "flex")]
EXCLUDED_TYPES = ["Здание", "Коммерческая земля", "Складское помещение", "Производственное помещение", "Гостиница"]

#: Trade forms.
AUCTION = "Открытый аукцион в электронной форме"
PUBLIC_OFFER = "Продажа посредством публичного предложения"
NO_PRICE = "Продажа без объявления цены"
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
#: Confidences that count as a match.
MATCHED = ["high", "medium", "low", "existing_tenant"]

# Kinds of streets in addresses, and their short forms in keys of buildings.
STREET_KINDS = ["улица", "ул.", "проспект", "пр-кт.", "пр-кт", "пр.", "шоссе", "ш.", "переулок", "пер.", "проезд", "бульвар", "б-р", "аллея", "набережная", "наб.", "площадь", "тупик"]
STREET_SHORT = {"улица": "ул.", "переулок": "пер.", "проезд": "пр.", "проспект": "пр-кт.", "шоссе": "ш.", "бульвар": "б-р", "набережная": "наб."}

# Entrance labels that count as an own entrance, and as a shared one.
SEPARATE_ENTRANCES = ["отдельный", "отдельный с улицы", "отдельный со двора"]
SHARED_ENTRANCES = ["общий", "общий с улицы", "через подъезд", "через холл"]
