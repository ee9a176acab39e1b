"""Given names by script and gender, and titles with the gender they tell
(fixed values: common public names)."""

GIVEN = {
    ("latin", "f"): (
        "Alice Amelia Andrea Anna Barbara Camille Carla Carmen Caroline Catherine Charlotte Chloe "
        "Christine Claire Clara Diana Elena Elisabeth Emily Emma Eva Frida Greta Hannah Heidi Helen "
        "Ingrid Isabel Jane Jennifer Jessica Julia Karin Laura Linda Lucia Margaret Maria Marie Marta "
        "Mary Monica Nicole Olivia Patricia Paula Petra Rachel Rosa Sabine Sarah Sofia Sophie Susan "
        "Sylvie Teresa Ursula Valerie Victoria Priya Ananya Lakshmi Kavita Sunita Aisha Fatima Yuki Sakura "
        "María Lucía Sofía Hélène Zoë Amara Ngozi Ayşe").split(),
    ("latin", "m"): (
        "Adam Albert Alexander Andreas Anthony Antonio Benjamin Bernard Carlos Charles Christian "
        "Daniel David Dieter Edward Emil Felix Fernando Francisco Frank Friedrich George Guillaume "
        "Hans Heinrich Henri Hugo Jacques James Javier John Joseph Juan Karl Klaus Louis Lucas Luis "
        "Manuel Marc Martin Matthew Michael Miguel Nicolas Olivier Oscar Otto Patrick Paul Pedro Peter "
        "Philippe Pierre Rafael Richard Robert Stefan Thomas William Wolfgang José Jesús Ángel Andrés Björn "
        "Jürgen François Søren Arjun Rahul Rohan Sanjay Deepak Wei Hiroshi Kenji Mohammed Ahmed Hassan "
        "Kwame Chidi Mehmet").split(),
    ("cyrillic", "f"): (
        "Анастасия Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария "
        "Марина Надежда Наталья Ольга Светлана Софья Татьяна Юлия").split(),
    ("cyrillic", "m"): (
        "Александр Алексей Андрей Антон Борис Василий Виктор Владимир Григорий Дмитрий Евгений Иван "
        "Максим Михаил Николай Олег Павел Пётр Сергей Юрий").split(),
    ("greek", "f"): "Αγγελική Αικατερίνη Αναστασία Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνης Γεώργιος Δημήτρης Ιωάννης Κώστας Νικόλαος Παναγιώτης Σπύρος".split(),
}
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f",
    "Señora": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f", "Dr": "", "Prof": "", "Professor": "",
}
