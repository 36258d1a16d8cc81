"""Precision and recall by block on 40 hand-labelled pages: eight layouts in four languages and in Chinese.

A page is a list of (markup, text, belongs to the article). Unmarked ones hold notices, copyright lines and menus
without a class, which only the rules can tell from the article. Their paragraphs have fewer than 200 characters.
"""

import pytest

from paylens.llm.html_text import main_text

# Per language: three paragraphs, a short one, a heading, a source, menu words, a notice, a copyright line, a comment.
TEXTS = {
    "en": (
        "The river had risen for three days before the old bridge gave way, and by the time the engineers came there was nothing left of the middle arch that they could have saved.",
        "It was built in the year of the great fire by masons who had come down from the hills, and for most of its life it was the only way to bring a cart to the market on the other side.",
        "What will be done with the stones is not yet clear, but the council says that it would like to have them in the new crossing, if the money for it can be found before the winter.",
        "Nobody was hurt.", "How the bridge fell", "Report of the county on old bridges", ("News", "Sport", "Weather", "Contact"),
        "Sign up today for daily headlines.", "© 2024 Valley Press", "I was there when it happened and it was the loudest thing that I have ever heard in my life.",
    ),
    "de": (
        "Der Fluss war seit drei Tagen gestiegen, bevor die alte Brücke nachgab, und als die Ingenieure kamen, war von dem mittleren Bogen nichts mehr da, was sie noch hätten retten können.",
        "Sie wurde in dem Jahr des großen Feuers von Maurern gebaut, die aus den Bergen gekommen waren, und war für die meiste Zeit der einzige Weg, mit einem Karren auf den Markt zu kommen.",
        "Was mit den Steinen wird, ist noch nicht klar, aber der Rat sagt, dass er sie in der neuen Brücke haben will, wenn das Geld für sie noch vor dem Winter zu finden ist.",
        "Verletzt wurde niemand.", "Wie die Brücke fiel", "Bericht des Kreises über alte Brücken", ("Nachrichten", "Sport", "Wetter", "Kontakt"),
        "Jetzt Newsletter bestellen.", "© 2024 Talpresse", "Ich war dabei, als es passierte, und es war das Lauteste, was ich in meinem Leben gehört habe.",
    ),
    "fr": (
        "La rivière montait depuis trois jours quand le vieux pont a cédé, et à l'arrivée des ingénieurs il ne restait plus rien de la voûte du milieu que l'on aurait pu sauver avec les moyens de la ville.",
        "Il a été construit dans l'année du grand incendie par des maçons qui étaient descendus de la montagne, et il est resté pour longtemps le seul chemin pour mener une charrette au marché de la ville.",
        "Ce que l'on fera des pierres n'est pas encore clair, mais le conseil dit qu'il voudrait les avoir dans le nouveau pont, si on trouve de l'argent pour les travaux avant la fin de l'année.",
        "Personne n'a été blessé.", "Comment le pont est tombé", "Rapport du canton sur les vieux ponts", ("Actualités", "Sport", "Météo", "Contact"),
        "Abonnez-vous dès maintenant.", "© 2024 Presse du Val", "Je me trouvais là quand il est tombé et c'est le plus grand bruit que j'ai entendu de ma vie.",
    ),
    "es": (
        "El río llevaba tres días creciendo cuando el viejo puente se vino abajo, y al llegar los ingenieros no quedaba nada del arco de en medio que se hubiera podido salvar con los medios de la villa.",
        "Se construyó en el año del gran incendio por los canteros que habían bajado de la sierra, y fue por mucho tiempo el único camino para llevar un carro al mercado que está en la otra orilla.",
        "Lo que se hará con las piedras no está claro, pero el concejo dice que las quiere para el nuevo paso, si es que se encuentra el dinero para la obra antes de que llegue el invierno.",
        "No hubo heridos.", "Cómo cayó el puente", "Informe de la comarca sobre los puentes viejos", ("Noticias", "Deportes", "Tiempo", "Contacto"),
        "Reciba nuestros titulares diarios.", "© 2024 Prensa del Valle", "Yo estaba allí cuando pasó y es lo más fuerte que he oído en la vida, no se me va de la cabeza.",
    ),
    "zh": (
        "河水已经上涨了三天，老桥终于在夜里倒塌了。工程师赶到的时候，中间的桥拱已经什么都没有了，他们也没有办法把它救回来。附近的居民说，他们在睡梦中听到了一声巨响。",
        "这座桥是在大火那一年由从山上下来的石匠建造的，在很长的时间里，它是用车把货物运到对岸市场上的唯一的路。人们对它有着很深的感情，不少老人在这里长大。",
        "这些石头会怎么处理，现在还不清楚，但是镇上的人说，如果能在冬天之前找到钱，他们想把石头用在新的桥上，让大家还能看到它的样子，也为了纪念那些石匠。",
        "没有人受伤。", "老桥是怎么倒的", "全县老桥调查报告", ("首页", "体育", "天气", "联系"),
        "立即订阅每日头条。", "© 2024 河谷日报", "我当时就在那里，那是我一生中听到过的最大的声音，到现在还是忘不了。",
    ),
}


def paragraph(text, keep=True):
    return (f"<p>{text}</p>", text, keep)


def linked(text, keep=True):
    return (f'<p><a href="/x">{text}</a></p>', text, keep)


def menu(words):
    return [("<ul>", None, False), *[(f'<li><a href="/{i}">{w}</a></li>', w, False) for i, w in enumerate(words)], ("</ul>", None, False)]


def within(opening, blocks, closing):
    return [(opening, None, False), *blocks, (closing, None, False)]


def layouts(lang):
    one, two, three, short, heading, source, words, notice, rights, comment = TEXTS[lang]
    head, story = [(f"<h1>{heading}</h1>", heading, True)], [paragraph(one), paragraph(two), paragraph(three)]
    start, end = one[: len(one) // 3], one[len(one) // 3 :]
    in_line = (f'<p>{start}<a href="/more">{end}</a></p>', one, True)
    sources = [("<ul>", None, False), *[(f'<li><a href="/{i}">{source} {i}</a></li>', f"{source} {i}", True) for i in range(4)], ("</ul>", None, False)]
    cells = [("<table><tr>", None, False), *[(f"<td>{x}</td>", x, True) for x in ("1850", "12 m", "1903", "14 m")], ("</tr></table>", None, False)]
    nav = within("<nav>", menu(words), "</nav>")
    foot = within("<footer>", [paragraph(rights, False)], "</footer>")
    return {
        "links in an article": [*nav, *within("<article>", [*head, in_line, linked(source), paragraph(two), (f'<p>{short} <a href="/y">{source}</a></p>', f"{short} {source}", True)], "</article>"), *foot],
        "list of sources": [*nav, *within("<article>", [*head, *story, *sources], "</article>"), *foot],
        "captions and tables": [*nav, *within("<article>", [*head, paragraph(one), (f"<figure><img src=a><figcaption>{short}</figcaption></figure>", short, True), *cells, paragraph(two)], "</article>"), *foot],
        "comments as articles": [
            *nav, *within("<main>", [*within("<article>", [*head, *story, paragraph(short)], "</article>"), *within('<div id="comments">', [paragraph(comment, False)], "</div>"), *within('<article class="comment">', [paragraph(comment, False)], "</article>")], "</main>"), *foot,
        ],
        "main with a sidebar": [*nav, *within('<div role="main">', [*head, *story, paragraph(short), *within('<div class="sidebar">', [paragraph(notice, False), linked(source, False)], "</div>")], "</div>"), *foot],
        "unmarked": [*menu(words), *within("<div>", [*head, *story, paragraph(short), paragraph(two)], "</div>"), *menu(words), paragraph(rights, False)],
        "unmarked with a list": [*menu(words), *within("<div>", [*head, paragraph(one), ("<ul>", None, False), (f"<li>{short}</li>", short, True), (f"<li>{source}</li>", source, True), ("</ul>", None, False), paragraph(two), paragraph(three)], "</div>"), *menu(words)],
        "unmarked with notices": [*menu(words), paragraph(notice, False), *menu(words), *within("<div>", [*head, *story, (f'<p>{two} <a href="/z">{words[0]}</a></p>', f"{two} {words[0]}", True)], "</div>"), *menu(words[::-1]), paragraph(rights, False)],
    }


def counts(page):
    """Right, wrong and lost blocks of a page; texts that stand on it twice count twice."""
    got = main_text("<html><body>" + "".join(markup for markup, _, _ in page) + "</body></html>").split("\n")
    got = [g for g in got if g]
    want = [" ".join(text.split()) for _, text, keep in page if keep]
    right = sum(min(got.count(t), want.count(t)) for t in set(want))
    return right, len(got) - right, len(want) - right


def test_precision_and_recall_by_block():
    all_counts = {(lang, name): counts(page) for lang in TEXTS for name, page in layouts(lang).items()}
    right, wrong, lost = map(sum, zip(*all_counts.values(), strict=True))
    print(f"{len(all_counts)} pages, precision {right / (right + wrong):.3f}, recall {right / (right + lost):.3f}", {k: v for k, v in all_counts.items() if v[1] or v[2]})
    assert right / (right + wrong) >= 0.9 and right / (right + lost) >= 0.9
    assert len(all_counts) == 40


@pytest.mark.parametrize("lang", TEXTS)
def test_marked_articles_lose_nothing(lang):
    for name, page in layouts(lang).items():
        if not name.startswith("unmarked"):
            assert counts(page)[1:] == (0, 0), name


def test_links_in_a_marked_article_are_content():
    page = '<article><p>First paragraph.</p><p>See <a href="r">the report</a> for more.</p><p>Last paragraph.</p></article>'
    assert main_text(page).split("\n") == ["First paragraph.", "See the report for more.", "Last paragraph."]


def test_chinese_without_an_article():
    assert main_text(f"<div>{TEXTS['zh'][0]}</div>") == TEXTS["zh"][0]
    assert main_text("<div>首页</div><ul><li><a href=a>新闻</a><li><a href=b>体育</a></ul>") == ""
