"""Words the fake values are made of. Changing one changes every fake."""

FIRST_NAMES = [
    "Ada", "Alan", "Amir", "Anika", "Aroha", "Bea", "Carlos", "Chen",
    "Dana", "Elif", "Emeka", "Farah", "Grace", "Hana", "Ines", "Ivan",
    "Jonas", "Kiri", "Lena", "Luca", "Mara", "Mele", "Nadia", "Noor",
    "Oskar", "Petra", "Ravi", "Sione", "Tala", "Uma", "Viktor", "Yuki",
]

LAST_NAMES = [
    "Abara", "Becker", "Castro", "Dubois", "Eriksen", "Fonoti", "Garcia", "Haddad",
    "Ivanova", "Jansen", "Kaur", "Lindqvist", "Moreau", "Nakamura", "Okafor", "Patel",
    "Quinn", "Rossi", "Silva", "Tanaka", "Ueda", "Vaka", "Weber", "Xu",
    "Yilmaz", "Zhang", "Adeyemi", "Brandt", "Costa", "Demir", "Ekström", "Faleolo",
]

CITIES = [
    "Apia", "Bergen", "Cusco", "Dakar", "Essen", "Fes", "Ghent", "Hobart",
    "Izmir", "Jaipur", "Kyoto", "Lagos", "Malmo", "Nadi", "Oslo", "Porto",
    "Quito", "Riga", "Suva", "Turin", "Utrecht", "Vigo", "Wuhan", "Xalapa",
]

MAIL_DOMAINS = ["example.com", "example.net", "example.org", "mail.example"]

LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor "
    "incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud "
    "exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure "
    "dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt "
    "mollit anim id est laborum. "
)
