import pytest
from lakecurator.plans.settings import SettingsError, settings_of


def test_defaults_are_valid():
    found = settings_of({"policy": [{"scope": ["*"], "downloads": True}]})
    assert found.get("albums", "soft_cap") == 4000 and len(found.policies) == 1


@pytest.mark.parametrize(
    "raw",
    [
        {"typo": {}},
        {"albums": {"typo": 1}},
        {"albums": []},
        {"albums": {"soft_cap": 0}},
        {"albums": {"soft_cap": True}},
        {"albums": {"soft_cap": 9000}},
        {"albums": {"photo": "no year"}},
        {"albums": {"photo": "{yyyy} {who}"}},
        {"project": {"timezone": "Mars/Base"}},
        {"import": {"heic": "maybe"}},
        {"import": {"same_max": 30}},
        {"import": {"existing": "/"}},
        {"organize": {"dates": ["guess"]}},
        {"organize": {"group": [{"name": "x"}]}},
        {"organize": {"group": [{"name": "x", "make": "a", "shape": "b"}]}},
        {"naming": {"keep_day": 1}},
        {"naming": {"month": "{yyyy}"}},
        {"policy": [{"downloads": True}]},
        {"policy": [{"scope": ["*"], "downloads": 1}]},
        {"policy": [{"scope": "x", "colour": "red"}]},
    ],
)
def test_problems_are_found(raw):
    with pytest.raises(SettingsError):
        settings_of(raw)


def test_all_problems_are_reported_at_once():
    with pytest.raises(SettingsError) as error:
        settings_of({"typo": {}, "albums": {"soft_cap": 0, "photo": 5}, "policy": [{}]})
    assert len(error.value.problems) == 4
