"""Class names that hold a mark's word in another sense keep their block; those made of such words alone do not."""

import pytest

from parcelwise.llm import extraction

PAGE = "<html><body><div {0}><p>The only paragraph of the page.</p></div></body></html>"


@pytest.mark.parametrize(
    "name",
    ["content ad-free", "post comments-open", "elementor-widget elementor", "login-article", "share-price", "menu-recipes", "promotion-news", "social-policy"],
)
def test_kept(name):
    for attribute in ("class", "id"):
        page = PAGE.format(f'{attribute}="{name}"')
        assert extraction.main_text(extraction.parsed(page), set()) == "The only paragraph of the page."


@pytest.mark.parametrize("name", ["ad", "x ads", "cookie-banner", "site-footer", "sidebar-left", "ad_slot", "related-posts", "navMenu", "share-buttons"])
def test_dropped(name):
    page = "<html><body><div><p>Text.</p></div><div class='" + name.lower().replace("navmenu", "nav-menu") + "'>Other</div></body></html>"
    assert extraction.main_text(extraction.parsed(page), set()) == "Text."
